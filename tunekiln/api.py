"""File-level entry points: what a user runs on a folder of JSON-lines files.

Each function composes the operators; every slice (by default: each file) gets one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats as fm
from .functions.joins import join_on
from .operators import audit as au
from .operators import prep
from .plans import corpus_plan
from .session import land, prepare
from .sources.lines import read_lines
from .sources.records import parse_lines, to_samples


def load_jsonl(spark: SparkSession, path: str | list[str], materialize: bool = True,
               nonblank_numbers: bool = False) -> DataFrame:
    """Canonical samples of JSON-lines files: slice (file), line_no, nb_no, raw, status, fields.

    With ``materialize`` the parsed rows are landed once as Parquet under the checkpoint folder,
    so the audits that follow read columns instead of parsing JSON again. Physical line numbers
    need no shuffle; ``nonblank_numbers`` adds the non-blank numbering (a shuffle of the lines
    by file split), which only the non-blank bad-line report needs."""
    prepare(spark)
    lines = read_lines(spark, path, nonblank_numbers=nonblank_numbers)
    samples = to_samples(parse_lines(lines), keep=["slice", "line_no", "nb_no", "raw"])
    return land(samples, "samples") if materialize else samples


def validate(samples: DataFrame, by=("slice",)) -> DataFrame:
    """Validator report per slice: lines, format, empties, near duplicates, token percentiles,
    score, grade, passed, issues, advice."""
    return au.v_audit(samples, list(by), "line_no")


def analyze(samples: DataFrame, by=("slice",)) -> DataFrame:
    """Analyzer report per slice: length distribution, quality ratios and issues, first format."""
    by = list(by)
    first = au.first_records(samples, by, "line_no").select(*by, F.col("fmt_a").alias("format"))
    return join_on(join_on(au.length_stats(samples, by), au.quality_a(samples, by).drop("n"), by), first, by, "left")


def training_text(samples: DataFrame, by=("slice",), test_size: float = prep.SPLIT_TEST_SIZE,
                  seed: int = prep.SPLIT_SEED, id_col: str = "line_no") -> DataFrame:
    """Training rows: the per-row template (CPT text passes through), rows that fit no template
    marked ``unsupported``, and the exact test split per slice."""
    by = list(by)
    text = F.coalesce(fm.tpl_auto(), F.when(F.col("k_text"), F.col("text")))
    rows = samples.filter(F.col("status") != "bad_json").select(
        *by, id_col, text.alias("text"),
        F.when(text.isNull(), F.lit("unsupported")).otherwise(F.lit("ok")).alias("tpl_status"))
    return prep.split(rows, id_col, by, test_size, seed)


def plan(samples: DataFrame, by=("slice",), task: str = "chat", model: str = "qwen2-7b",
         gpu_gb: float = 24.0) -> DataFrame:
    """Training plan per slice (sequence length, rule columns, memory of the matched model)."""
    s = samples if "sample_id" in samples.columns else samples.withColumnRenamed("line_no", "sample_id")
    return corpus_plan.full_plan(s, list(by), task, model, gpu_gb)


def report(samples: DataFrame, path: str | None = None, by=("slice",)) -> DataFrame:
    """Both reports per slice as one document (analyzer: length, quality, format; validator:
    passed, stats, issues, advice); written as JSON when ``path`` is given."""
    from .sources.sinks import write_report
    rep = au.audit_report(samples, list(by), "line_no")
    if path:
        write_report(rep, path)
    return rep


def parse_errors(spark: SparkSession, path: str | list[str], samples: DataFrame, k: int = 10) -> DataFrame:
    """Per file: bad-line count, the first 3 physical line numbers (A) and the first 5 / 10
    non-blank line numbers (V / T). Only the reported lines get a non-blank number, from the
    blank-line positions of their file; the lines themselves are never shuffled."""
    from .operators.prep import top_k_per_group
    from .sources.lines import blank_lines, nonblank_numbers_of
    bad = samples.filter(F.col("status") == "bad_json").select("slice", "line_no")
    n = bad.groupBy("slice").agg(F.count(F.lit(1)).alias("n_bad"))
    top = top_k_per_group(bad, ["slice"], [F.col("line_no")], k).drop("rank")
    top = nonblank_numbers_of(top, blank_lines(spark, path))
    lst = top.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("line_no", "nb_no"))).alias("_l"))

    def first(m, field):
        return F.array_join(F.transform(F.slice("_l", 1, m), lambda x: x[field].cast("string")), ",")
    return n.join(lst.select("slice", first(3, "line_no").alias("first3_lines"),
                             first(5, "nb_no").alias("first5_nonblank"),
                             first(k, "nb_no").alias("first10_nonblank")), "slice")


def clean(samples: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """Rows of every format kept after dropping bad JSON, empty key fields and short replies; with
    ``max_tokens`` also over-long text."""
    return prep.clean(samples, max_tokens)


def dedupe(samples: DataFrame, by=("slice",), order: str = "line_no") -> DataFrame:
    """First record of each group with the same whole normalised text; ``group_size`` tells how many
    records the group had. Lines that are valid JSON but no object, records of unknown formats and
    records without text are compared by their whole line."""
    from .functions import text as tx
    by = list(by)
    valid = samples.filter(F.col("status") != "bad_json")
    text = F.when((F.col("status") == "ok") & (fm.fmt_v() != fm.FMT_UNKNOWN), fm.full_text_v(fm.fmt_v()))
    own = F.coalesce(~tx.is_blank(text), F.lit(False))
    key = F.concat(F.when(own, F.lit("t")).otherwise(F.lit("r")), F.hex(tx.text_key(F.when(own, text).otherwise(F.col("raw")))))
    return prep.keep_first(valid, key, order, by)


def pack(rows: DataFrame, seq_len: int = 4096, id_col: str = "line_no", text_col: str = "text",
         by=("slice",), ids_per_shard: int = prep.PACK_IDS_PER_SHARD) -> DataFrame:
    """Training rows (e.g. ``training_text``) packed into ``seq_len``-token sequences per slice, in id
    order; one row per piece with the slice and the row's id. Shards are fixed ranges of ids."""
    from .functions import text as tx
    by = list(by)
    t = rows.filter(F.col(text_col).isNotNull()).select(*by, id_col, tx.tokens_v(F.col(text_col)).alias("_tokens"))
    return prep.pack(t, id_col, "_tokens", seq_len, prep.range_shard(id_col, ids_per_shard), by).withColumnRenamed("sample_id", id_col)
