"""Per-slice training plans: statistics → sequence length → rule columns → model match → memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import text as tx
from ..functions.joins import join_on
from ..operators import audit as au
from ..operators.substrings import substring_join
from ..session import land
from . import catalog as cat
from . import rules as ru

# Model requests the registered plan queries run for (fixed values of the fixture).
PLAN_MODELS = ["qwen2-7b", "Qwen/Qwen2-7B-Instruct", "7b", "llama3_8b", "13b", "72B"]


def token_hist(samples: DataFrame, by: list[str]) -> DataFrame:
    """(slice, A token estimate, count): one text pass, landed, for every plan statistic."""
    return au.grouped_counts(au.a_rows(samples, by), by, ["tokens_f"])["tokens_f"]


def slice_stats(samples: DataFrame, by: list[str], hist: DataFrame | None = None) -> DataFrame:
    """A's sample count and integer token P95 per slice (what the plan is derived from)."""
    hist = hist if hist is not None else token_hist(samples, by)
    n = hist.groupBy(*by).agg(F.sum("_c").alias("n"))
    q = au.numpy_quantiles(None, by, "tokens_f", {"_p95": 0.95}, hist=hist)
    return join_on(n, q, by).select(*by, "n", F.col("_p95").cast("bigint").alias("p95_tokens")) \
            .withColumn("seq_len", tx.seq_len_from_p95(F.col("p95_tokens")))


def seq_len_plan(samples: DataFrame, by: list[str]) -> DataFrame:
    """Sequence length per slice and the rows (A token estimate) above it, from one histogram."""
    hist = token_hist(samples, by)
    st = slice_stats(samples, by, hist)
    over = (join_on(hist, st.select(*by, "seq_len"), by)
            .groupBy(*by).agg(F.sum(F.when(F.col("tokens_f") > F.col("seq_len"), F.col("_c")).otherwise(0))
                              .alias("over_count")))
    out = join_on(st, over, by)
    return out.select(*by, "n", "p95_tokens", "seq_len", "over_count",
                      tx.round_even(F.col("over_count") / F.col("n"), 4).alias("over_share"))


def match_models(req: DataFrame, name_col: str, catalog: DataFrame | None = None) -> DataFrame:
    """Each request row gets ``matched_model`` (catalogue struct): substring match either way after
    normalising; nearest to 7e9 parameters, then catalogue order; else the 7B default.

    ``catalog`` may be a user's own table (pos, name, params, hidden, layers, is_moe, total_params). The distinct
    request names meet the catalogue through two substring joins, one in each direction."""
    bare = lambda c: F.replace(F.lower(F.col(c)), F.lit("-"), F.lit(""))
    names = land(req.select(F.col(name_col).alias("_name"), F.replace(bare(name_col), F.lit("_"), F.lit("")).alias("_nm")).distinct(), "model-names")
    table = catalog if catalog is not None else cat.models_table(req.sparkSession)
    models = table.select(F.struct("pos", "name", "params", "hidden", "layers", "is_moe", "total_params").alias("_c"), F.replace("name", F.lit("-"), F.lit("")).alias("_key"))
    asked = names.filter("_nm <> ''")
    hits = substring_join(asked, F.col("_nm"), models, F.col("_key")).unionByName(substring_join(models, F.col("_key"), asked, F.col("_nm")))
    order = F.struct(F.abs(F.col("_c.params") - F.lit(7e9)), F.col("_c.pos"))
    best = hits.groupBy("_name").agg(F.min_by("_c", order).alias("_best"))
    out = join_on(req.withColumn("_name", F.col(name_col)), best, "_name", "left")
    return out.withColumn("matched_model", F.coalesce("_best", cat.default_model())).drop("_name", "_best")


def fit(seq: DataFrame) -> DataFrame:
    """Slice × catalogue model × card memory (QLoRA, checkpointing) with headroom verdicts."""
    x = seq.select("*", F.explode(cat.models_array()).alias("m"))
    x = x.select("*", F.explode(cat.gpus_array()).alias("g"))
    r, _ = ru.rank(F.col("n"), F.lit("chat"))
    mods = F.size(ru.target_modules(F.lit("chat"), F.col("m.name")))
    x = x.select("slice", "n", "seq_len", F.col("m.name").alias("model"), F.col("m.params").alias("params"),
                 F.col("m.hidden").alias("hidden"), F.col("m.layers").alias("layers"),
                 F.col("g.gpu").alias("gpu"), F.col("g.gpu_gb").alias("gpu_gb"), r.alias("rank"),
                 ru.batch_size(F.col("g.gpu_gb")).alias("batch_size"), mods.alias("modules"))
    mem = ru.memory(F.col("params"), F.col("hidden"), F.col("layers"), F.col("seq_len"), F.col("batch_size"),
                    F.col("rank"), F.col("modules"))
    x = x.withColumn("mem", mem)
    # the verdicts read the rounded total, as the reported memory figure is rounded first
    x = x.withColumn("hv", ru.headroom_verdict(F.col("mem.total"), F.col("gpu_gb")))
    x = x.withColumn("cv", ru.card_verdict(F.col("mem.total")))
    return x.select("slice", "model", "gpu", "seq_len", "rank", "batch_size", "modules",
                    "mem.model_weight", "mem.activation", "mem.optimizer", "mem.overhead", "mem.total",
                    "hv.headroom_gb", "hv.fits", "hv.headroom_band", "cv.card_gb", "cv.status", "cv.advice")


def apply_overrides(plan: DataFrame, ov: DataFrame, cols: list[str], on: str | list[str] = "slice") -> DataFrame:
    """Override values win; the reason of an overridden value gains the override tag."""
    on = [on] if isinstance(on, str) else on
    o = ov.select(*on, *[F.col(c).alias("_ov_" + c) for c in cols])
    j = join_on(plan, o, on, "left")
    for c in cols:
        hit = F.col("_ov_" + c).isNotNull()
        j = j.withColumn(c + "_overridden", hit).withColumn(c, F.coalesce(F.col("_ov_" + c), F.col(c)))
        if c + "_reason" in plan.columns:
            j = j.withColumn(c + "_reason", F.when(hit, F.concat(F.col(c + "_reason"), F.lit(ru.OVERRIDE_TAG)))
                             .otherwise(F.col(c + "_reason")))
    return j.drop(*["_ov_" + c for c in cols])


# Values that an override document may hold, below the same keys as in the plan document.
OVERRIDE_SCHEMA = ("config struct<rank: struct<value: int>, alpha: struct<value: int>, learning_rate: struct<value: double>, "
                   "epochs: struct<value: int>, batch_size: struct<value: int>>, max_seq_length bigint")
OVERRIDE_COLUMNS = ["rank", "alpha", "learning_rate", "epochs", "batch_size"]


def override_columns(docs: DataFrame, by: list[str], document: str = "document") -> DataFrame:
    """Override documents (JSON text per slice, nested as the plan document is) as columns; keys that a document
    leaves out, or that a plan does not have, stay null."""
    d = docs.select(*by, F.from_json(document, OVERRIDE_SCHEMA).alias("_o"))
    return d.select(*by, *[F.col(f"_o.config.{c}.value").alias(c) for c in OVERRIDE_COLUMNS], F.col("_o.max_seq_length").alias("seq_len"))


def full_plan(samples: DataFrame, by: list[str], task: str = "chat", model: str = "qwen2-7b",
              gpu_gb: float = ru.DEFAULT_GPU_GB, overrides: DataFrame | None = None) -> DataFrame:
    """One row per slice: audit summary, sequence length, rule columns with their reasons, and the matched model's memory.

    ``overrides`` (``by``, document) are merged into the rule columns first: given values win and their reasons
    gain the tag; steps and memory follow from the merged values."""
    st = slice_stats(samples, by)
    first = au.first_records(samples, by, "sample_id").select(*by, fm.map_format(F.col("fmt_a")).alias("data_format"))
    q = au.quality_a(samples, by).select(*by, F.struct("has_issues", "issues", "empty_output_ratio", "duplicate_ratio", "bilingual_ratio").alias("quality"))
    req = join_on(join_on(st, first, by), q, by, "left")
    req = req.withColumn("task", F.lit(task)).withColumn("model", F.lit(model)).withColumn("gpu_gb", F.lit(float(gpu_gb)))
    hp = ru.hyperparams(req)
    if overrides is not None:
        hp = ru.schedule(apply_overrides(hp, override_columns(overrides, by), [*OVERRIDE_COLUMNS, "seq_len"], by))
    hp = match_models(hp, "model")
    mem = ru.memory(F.col("matched_model.params"), F.col("matched_model.hidden"), F.col("matched_model.layers"), F.col("seq_len"),
                    F.col("batch_size"), F.col("rank"), F.size("target_modules"))
    why = [c for c in hp.columns if c.endswith("_reason")]
    return hp.select(*by, "n", "p95_tokens", "seq_len", "data_format", "rank", "alpha", "learning_rate", "epochs",
                     "batch_size", "gradient_accumulation", "total_steps", "warmup_steps", "dropout", "target_modules",
                     mem["total"].alias("memory_total_gb"), mem.alias("memory"), "quality", "task", "model", *why)


def plan_document(plan: DataFrame, by: list[str]) -> DataFrame:
    """The plan of each slice (``full_plan``) as one JSON document: config with value and reason, data summary,
    sequence length, memory."""
    def with_reason(c):
        return F.struct(F.col(c).alias("value"), F.col(c + "_reason" if c != "target_modules" else "modules_reason").alias("reason"))
    config = F.struct(*[with_reason(c).alias(c) for c in ("rank", "alpha", "target_modules", "dropout", "learning_rate", "epochs", "batch_size")],
                      F.struct(F.col("gradient_accumulation").alias("value")).alias("gradient_accumulation"),
                      F.col("task").alias("task_type"), F.col("model").alias("model_size"), F.col("n").alias("num_samples"))
    summary = F.struct(F.col("n").alias("num_samples"), "p95_tokens", F.col("data_format").alias("format"), "quality")
    steps = F.struct("total_steps", "warmup_steps")
    doc = F.struct(config.alias("config"), summary.alias("data_summary"), F.col("seq_len").alias("max_seq_length"), "memory", steps.alias("schedule"))
    return plan.select(*by, F.to_json(doc).alias("document"))


DOCUMENT_SCHEMA = ("config struct<rank: struct<value: int, reason: string>, alpha: struct<value: int, reason: string>, "
                   "learning_rate: struct<value: double, reason: string>, epochs: struct<value: int>, batch_size: struct<value: int>, "
                   "gradient_accumulation: struct<value: int>>, "
                   "data_summary struct<num_samples: bigint, p95_tokens: bigint, format: string, quality: struct<has_issues: boolean, duplicate_ratio: double>>, "
                   "max_seq_length bigint, memory struct<total: double>, schedule struct<total_steps: bigint, warmup_steps: bigint>")
