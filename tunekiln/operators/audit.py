"""Per-slice audits of canonical samples: parse counts, formats, lengths, quality, duplicates,
token percentiles, the V score, issues and advice.

Shape of every audit: one fused projection per row (each text built once), then partial +
final aggregation per slice. Exact-duplicate and near-duplicate counts aggregate by key first
(map-side combine absorbs hot keys such as the empty text) and then sum per slice. Token
percentiles come from a (slice, tokens) histogram, so no task ever holds a slice's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import text as tx
from ..functions.joins import join_on
from ..session import land
from ..sources.records import plain_numbers

# ---------------------------------------------------------------------------
# Thresholds, issue texts and advice texts of the reference rules.
# ---------------------------------------------------------------------------
V_SCORE_START = 100
V_BAD_LINE_WEIGHT, V_BAD_LINE_CAP = 2, 30
V_EMPTY_WEIGHT, V_EMPTY_CAP = 5, 25
V_DUP_WEIGHT, V_DUP_CAP = 2, 20
V_VERY_SMALL_N, V_VERY_SMALL_PENALTY = 100, 15
V_SMALL_N, V_SMALL_PENALTY = 500, 5
V_P95_LIMIT, V_P95_PENALTY = 4096, 10
V_MEAN_MIN, V_MEAN_PENALTY = 50, 10
V_GRADES = [(90, "Excellent"), (75, "Good"), (60, "Fair"), (40, "Poor")]
V_GRADE_LAST = "Unusable"
V_PASS_SCORE = 60
V_ISSUE_PARSE = "%d JSON parse error(s)"
V_ISSUE_EMPTY = "%d empty/missing field(s) (%.1f%%)"
V_ISSUE_DUPS = "%d near-duplicate group(s) (%d total duplicate samples)"
V_ISSUE_VERY_SMALL = "Very small dataset (%d samples, recommend  500)"
V_ISSUE_SMALL = "Small dataset (%d samples, 1000+ recommended)"
V_ISSUE_P95 = "P95 token length (%d) exceeds typical max_seq_length (4096)"
V_ISSUE_MEAN = "Average token length too short (%.0f), may lack sufficient training signal"
V_ADVICE_EXCELLENT = ["[OK] Data quality looks great! Ready for fine-tuning.", "Suggested: build a training plan for %s (plan_full)"]
V_ADVICE_GOOD = "[OK] Good enough for fine-tuning. Minor issues won't hurt much."
V_ADVICE_GOOD_PARSE_TIP = "Tip: Fix %d parse errors for cleaner training."
V_ADVICE_GOOD_DUP_TIP = "Tip: %d duplicates found. Some duplication is fine for SFT."
V_ADVICE_FAIR = ["[WARN] Trainable but quality could be better.",
                 "Fix: Check and fix the issues listed above, then re-run validation."]
V_ADVICE_POOR = ["[WARN] Significant quality issues. Training may produce poor results.",
                 "Fix: Review your data preparation pipeline.",
                 "Re-run with --show-issues for detailed diagnostics."]
V_ADVICE_UNUSABLE = ["[FAIL] Data quality is too poor for meaningful training.",
                     "Fix: Re-check your data source. Ensure proper JSONL format:",
                     '  {"instruction": "...", "output": "..."}',
                     '  {"messages": [{"role": "user", "content": "..."}, ...]}',
                     '  {"text": "..."}  (for CPT/pretraining)']
A_ISSUE_SHORT = "发现 %d 条回复过短（< 5 字符），可能是生成失败"
A_ISSUE_DUPS = "发现 %d 条完全重复数据，建议去重"
A_ISSUE_CONTROL = "发现 %d 条包含控制字符（\\t \\r \\x00），可能影响解析"
A_ISSUE_EMPTY_SET = "数据集为空！"
# Our thresholds (the reference names the alerts but sets no numbers in code).
ALERT_SHORT_SHARE = 0.05
ALERT_DUP_SHARE = 0.10
VALID_SHARE_MIN = 0.90
SLICE_BROADCAST_ROWS = 100_000
SALTS = 32
# ---------------------------------------------------------------------------



def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def attach_small(big: DataFrame, small: DataFrame, on: list[str], salt: str | None = None) -> DataFrame:
    """Join a written per-slice table (one row per slice) to the rows without moving the rows.

    The table is broadcast where it has at most SLICE_BROADCAST_ROWS rows (counted). With more slices
    the rows are joined on (slice, salt), so that a hot slice is spread over SALTS tasks."""
    if small.count() <= SLICE_BROADCAST_ROWS:
        return join_on(big, small, on, hint="broadcast")
    salts = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    key = F.pmod(F.xxhash64(salt) if salt else F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    return join_on(big.withColumn("_salt", key), salts, [*on, "_salt"]).drop("_salt")


def grouped_counts(rows: DataFrame, by: list[str], keys: list[str], aggs: list[Column] | None = None) -> dict:
    """Row counts per (by, key) for several keys and per (by) alone in ONE aggregation
    (GROUPING SETS): the per-row projection is evaluated once, one shuffle carries all sets,
    and partial aggregation before the shuffle absorbs hot keys.
    Returns {key: frame(by, key, _c, ...), None: frame(by, _c, ...)}."""
    cols = by + keys
    sets = [by + [k] for k in keys] + [list(by)]
    extra = aggs or []
    g = rows.groupingSets(sets, *cols).agg(F.count(F.lit(1)).alias("_c"), *extra, F.grouping_id().alias("_gid"))
    # The grouped table (at most one narrow row per distinct key) feeds several consumers whose
    # pruned plans differ, so Spark would not reuse the exchange: write it once as Parquet in the
    # checkpoint folder (reliable, columnar; also cuts the lineage of the text pass).
    g = land(g, "grouped")

    def gid(members):
        return sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in members)
    out = {}
    for k, st in zip(keys + [None], sets):
        keep = by + ([k] if k else [])
        out[k] = g.filter(F.col("_gid") == gid(st)).select(*keep, "_c", *[a for a in g.columns
                                                                          if a not in cols + ["_c", "_gid"]])
    return out


# ---- parse counts / format mix ---------------------------------------------

def parse_counts(samples: DataFrame, by=("slice",)) -> DataFrame:
    by = _by(by)
    bad = F.col("status") == "bad_json"
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(~bad).alias("valid_lines"),
        F.count_if(bad).alias("invalid_lines"),
    )


def slice_info(samples: DataFrame, by=("slice",), order: str = "line_no") -> DataFrame:
    """Line counts per slice and the first valid record's formats and keys, as a written table.

    The least order of the valid lines is a plain hash aggregate; the few rows that have it are then
    read by a join with that table, so no line is sorted or shuffled. Runs when it is called."""
    by = _by(by)
    bad = F.col("status") == "bad_json"
    counts = land(samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(~bad).alias("valid_lines"),
        F.count_if(bad).alias("invalid_lines"),
        F.min(F.when(~bad, F.col(order))).alias("_first")), "slice-counts")
    ok = F.col("status") == "ok"
    fmt = lambda f: F.when(ok, f()).otherwise(F.lit(fm.FMT_UNKNOWN))
    keys = F.json_object_keys(plain_numbers(F.col("raw"))) if "raw" in samples.columns else F.map_keys("fields")
    starts = counts.filter("_first is not null").select(*by, F.col("_first").alias(order))
    first = attach_small(samples.filter(~bad), starts, [*by, order], order).select(
        *by, fmt(fm.fmt_v).alias("fmt_v"), fmt(fm.fmt_a).alias("fmt_a"), fmt(fm.fmt_t).alias("fmt_t"),
        F.coalesce(F.when(ok, keys), F.array().cast("array<string>")).alias("first_keys")).dropDuplicates(by)
    out = join_on(counts.drop("_first"), first, by, "left")
    return land(out.withColumn("first_keys", F.coalesce("first_keys", F.array().cast("array<string>"))), "slice-info")


def first_records(samples: DataFrame, by=("slice",), order: str = "line_no") -> DataFrame:
    """Per slice: V/A/T format and key list of the first valid record."""
    by = _by(by)
    return slice_info(samples, by, order).filter(F.col("valid_lines") > 0).select(
        *by, "fmt_v", "fmt_a", "fmt_t", "first_keys")


def format_mix(samples: DataFrame, by=("slice",), order: str = "line_no") -> DataFrame:
    """Per slice and per-row format: count, plus the slice's first-record format and format count."""
    by = _by(by)
    rows = samples.filter(F.col("status") == "ok").select(*by, fm.fmt_canonical().alias("fmt"))
    per = rows.groupBy(*by, "fmt").agg(F.count(F.lit(1)).alias("n"))
    nfmt = per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_formats"))
    first = first_records(samples, by, order).select(*by, F.col("fmt_a").alias("first_fmt_a"),
                                                     F.col("fmt_v").alias("first_fmt_v"))
    return join_on(join_on(per, nfmt, by), first, by, "left")


# ---- V: validator audit -----------------------------------------------------

def _v_rows(samples: DataFrame, by: list[str], order: str, first: DataFrame | None = None) -> DataFrame:
    """Valid rows with the slice's key format attached and V's per-row values computed once."""
    first = first if first is not None else first_records(samples, by, order)
    valid = samples.filter(F.col("status") != "bad_json")
    j = attach_small(valid, first, by, order)
    kf = F.col("fmt_v")
    txt = fm.full_text_v(kf, F.col("first_keys"))
    j = j.withColumn("_tv", txt)
    return j.select(
        *by, order, "fmt_v", "first_keys",
        tx.fingerprint(F.col("_tv")).alias("fp"),
        tx.tokens_v(F.col("_tv")).alias("tokens"),
        _empty_fields_count(kf, F.col("first_keys")).alias("n_empty"),
    )


def empty_reason(k: str) -> Column:
    """Reason a format key's value is empty: missing/None, empty string, empty list; null when not empty.

    The value's own kind decides, whatever its key usually holds; numbers and objects are never empty."""
    kind = fm.odd(k)
    is_list = k in ("messages", "conversations")
    usual = (F.when((~F.col("k_" + k)) | F.col(k).isNull(), F.lit("missing/None"))
             .when(F.size(F.col(k)) == 0 if is_list else tx.is_blank(F.col(k)), F.lit("empty list" if is_list else "empty string")))
    return F.when(kind.isNull(), usual).otherwise(_odd_reason(kind, F.col("fields")[k]))


def _odd_reason(kind: Column, text: Column) -> Column:
    return (F.when(kind == "null", F.lit("missing/None")).when((kind == "string") & tx.is_blank(text), F.lit("empty string"))
            .when(kind == "empty list", F.lit("empty list")))


def any_filled() -> Column:
    """Whether any top-level value of a record is not empty."""
    out = F.exists(F.map_keys("kinds"), lambda k: _odd_reason(F.col("kinds")[k], F.col("fields")[k]).isNull())
    for k in fm.KNOWN_KEYS:
        out = out | (F.col("k_" + k) & empty_reason(k).isNull())
    return out


def _empty_fields_count(kf: Column, first_keys: Column) -> Column:
    n = lambda k: empty_reason(k).isNotNull().cast("int")

    def any_key(k):
        known = F.lit(None).cast("string")
        for f in fm.KNOWN_KEYS:
            known = F.when(k == f, empty_reason(f)).otherwise(known)
        kind = F.col("kinds")[k]
        other = F.when(kind.isNull(), F.lit("missing/None")).otherwise(_odd_reason(kind, F.col("fields")[k]))
        return F.when(k.isin(*fm.KNOWN_KEYS), known).otherwise(other).isNotNull().cast("int")

    return (
        F.when(kf == fm.FMT_MESSAGES, n("messages"))
        .when(kf == fm.FMT_IO, n("instruction") + n("output"))
        .when(kf == fm.FMT_CONV, n("conversations"))
        .when(kf == fm.FMT_V_TEXT, n("text"))
        .otherwise(F.aggregate(first_keys, F.lit(0), lambda acc, k: acc + any_key(k)))
    )


def nearest_rank(hist: DataFrame, by: list[str], value: str, count: str, ranks: dict[str, Column]) -> DataFrame:
    """Nearest-rank percentiles from a (by, value, count) histogram: for each name → k (0-based
    rank column expression over ``n``), the smallest value whose running count exceeds k."""
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("_cum", F.sum(count).over(w))
    h = h.withColumn("_n", F.sum(count).over(Window.partitionBy(*by)))
    aggs = [F.min(F.when(F.col("_cum") > k, F.col(value))).alias(name) for name, k in ranks.items()]
    return h.groupBy(*by).agg(*aggs)


def token_stats(rows: DataFrame, by: list[str], tokens: str = "tokens", p99: bool = True,
                hist: DataFrame | None = None) -> DataFrame:
    """Mean and nearest-rank P50/P95/P99 of integer tokens: sorted[n//2], sorted[min(int(n*p), n-1)]."""
    if hist is None:
        hist = rows.groupBy(*by, tokens).agg(F.count(F.lit(1)).alias("_c"))
    n = F.col("_n")
    ranks = {
        "p50_tokens": F.floor(n / F.lit(2)),
        "p95_tokens": F.least(F.floor(n * F.lit(0.95)), n - 1),
    }
    if p99:
        ranks["p99_tokens"] = F.least(F.floor(n * F.lit(0.99)), n - 1)
    pct = nearest_rank(hist, by, tokens, "_c", ranks)
    base = hist.groupBy(*by).agg(
        F.sum("_c").alias("n"), F.sum(F.col(tokens) * F.col("_c")).alias("total_tokens"))
    return join_on(base, pct, by).withColumn("avg_tokens", F.col("total_tokens") / F.col("n"))


def near_dups(rows: DataFrame, by: list[str], key: str = "fp", counts: DataFrame | None = None) -> DataFrame:
    """Groups sharing a key: number of groups with more than one row, and Σ(count − 1)."""
    g = counts if counts is not None else rows.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_c"))
    return g.groupBy(*by).agg(
        F.count_if(F.col("_c") > 1).alias("dup_count"),
        F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c") - 1)), F.lit(0)).alias("total_duplicates"),
    )


def v_audit(samples: DataFrame, by=("slice",), order: str = "line_no") -> DataFrame:
    """V statistics per slice: lines, format, empties, near-dups, token stats, score, grade, passed.

    Two scans read line counts and the first record of each slice (no text but the first
    records'), one pass reads the texts; its three groupings (fingerprint, tokens, slice) share one
    GROUPING SETS aggregation. These run when the function is called; what is returned reads their
    small written results."""
    by = _by(by)
    sinfo = slice_info(samples, by, order)
    first = sinfo.filter(F.col("valid_lines") > 0).select(*by, "fmt_v", "fmt_a", "fmt_t", "first_keys")
    rows = _v_rows(samples, by, order, first)
    parts = grouped_counts(rows.withColumn("fp", F.unhex(F.md5("fp"))), by, ["fp", "tokens"],
                           [F.sum("n_empty").alias("_e")])
    dups = near_dups(None, by, "fp", parts["fp"])
    toks = token_stats(None, by, "tokens", hist=parts["tokens"])
    basic = parts[None].select(*by, F.col("_e").cast("bigint").alias("empty_count"))
    counts = sinfo.select(*by, "total_lines", "valid_lines", "invalid_lines",
                          F.col("fmt_v").alias("detected_format"), F.col("first_keys").alias("key_fields"))
    s = join_on(join_on(join_on(counts, basic, by, "left"), dups, by, "left"), toks.drop("n"), by, "left")
    return score_v(s)


def audit_rollup(samples: DataFrame, by: list[str]) -> DataFrame:
    """The audit of every level of ``by`` at once: each full group, each prefix of ``by``, and the total.

    One text pass counts the distinct values (tokens, lengths, fingerprints, digests) of the finest groups; counts
    are additive, so the histograms of the coarser levels are sums of the finer ones and all percentiles,
    duplicates, scores and grades are exact at every level. ``level`` is 0 for the full groups, then 1, 3, 7, ... as
    columns are rolled up from the right (a grouping id); columns rolled up are null. V's text follows
    each row's own format, as a level has no single first record."""
    valid = F.col("status") != "bad_json"
    text = fm.full_text_v(fm.fmt_v(), F.map_keys("fields"))
    rows = samples.withColumn("_tv", F.when(valid, F.coalesce(text, F.lit(""))))
    rows = rows.select(*by, valid.alias("valid"), F.unhex(F.md5(tx.fingerprint("_tv"))).alias("fp"), tx.tokens_v("_tv").alias("tokens"),
                       tx.char_len("_tv").alias("chars"), F.unhex(F.md5("_tv")).alias("text_key"),
                       F.when(valid, _empty_fields_count(fm.fmt_v(), F.map_keys("fields"))).alias("n_empty"),
                       (valid & tx.is_short_output(fm.output_text_a())).alias("short"))
    parts = grouped_counts(rows, by, ["fp", "tokens", "chars", "text_key"], [
        F.count_if("valid").alias("valid_lines"), F.sum("n_empty").alias("empty_count"), F.count_if("short").alias("short_count")])
    keys = ["level", *by]

    def levels(df: DataFrame, more: list[str], aggs: list[Column]) -> DataFrame:
        out = None
        for k in range(len(by), -1, -1):
            g = df.groupBy(*by[:k], *more).agg(*aggs)
            rolled = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in by[k:]]
            g = g.select(F.lit((1 << (len(by) - k)) - 1).alias("level"), *by[:k], *rolled, *[c for c in g.columns if c not in by[:k]])
            out = g if out is None else out.unionByName(g)
        return out

    def counts(key: str) -> DataFrame:
        return levels(parts[key].filter("valid_lines > 0"), [key], [F.sum("valid_lines").alias("_c")])

    base = levels(parts[None], [], [F.sum("_c").alias("total_lines"), *[F.sum(c).cast("bigint").alias(c) for c in ("valid_lines", "empty_count", "short_count")]])
    base = base.withColumn("invalid_lines", F.col("total_lines") - F.col("valid_lines"))
    exact = counts("text_key").groupBy(*keys).agg((F.sum("_c") - F.count(F.lit(1))).alias("duplicate_count"))
    chars = numpy_quantiles(None, keys, "chars", {"p80_chars": 0.8, "p95_chars": 0.95}, median="median_chars", hist=counts("chars"))
    ends = levels(parts["chars"].filter("valid_lines > 0"), [], [F.min("chars").cast("bigint").alias("min_chars"), F.max("chars").cast("bigint").alias("max_chars")])
    s = base
    for part in (near_dups(None, keys, "fp", counts("fp")), token_stats(None, keys, hist=counts("tokens")).drop("n"), exact, chars, ends):
        s = join_on(s, part, keys, "left")
    name = F.concat_ws("/", *[F.coalesce(c, F.lit("")) for c in by])
    return score_v(s.select(name.alias("name"), *s.columns)).drop("name")


def score_v(s: DataFrame) -> DataFrame:
    """Rule R1 on per-slice statistics: score, grade, passed, issues and advice."""
    valid = F.col("valid_lines")
    inv = F.coalesce(F.col("invalid_lines"), F.lit(0))
    empty = F.coalesce(F.col("empty_count"), F.lit(0))
    dupc = F.coalesce(F.col("dup_count"), F.lit(0))
    dupt = F.coalesce(F.col("total_duplicates"), F.lit(0))
    p95 = F.col("p95_tokens")
    avg = F.col("avg_tokens")
    empty_pct = F.try_divide(empty, valid) * F.lit(100)
    dup_pct = F.try_divide(dupt, valid) * F.lit(100)
    # subtract one penalty at a time, as the rule does, so the floats agree bit for bit
    penalties = [
        F.when(inv > 0, F.least(F.lit(V_BAD_LINE_CAP), inv * V_BAD_LINE_WEIGHT)).otherwise(0).cast("double"),
        F.when(empty > 0, F.least(F.lit(float(V_EMPTY_CAP)), empty_pct * F.lit(float(V_EMPTY_WEIGHT)))).otherwise(0.0),
        F.when(dupc > 0, F.least(F.lit(float(V_DUP_CAP)), dup_pct * F.lit(float(V_DUP_WEIGHT)))).otherwise(0.0),
        F.when(valid < V_VERY_SMALL_N, V_VERY_SMALL_PENALTY).when(valid < V_SMALL_N, V_SMALL_PENALTY).otherwise(0),
        F.when(p95 > V_P95_LIMIT, V_P95_PENALTY).otherwise(0),
        F.when(avg < V_MEAN_MIN, V_MEAN_PENALTY).otherwise(0),
    ]
    raw_score = F.lit(float(V_SCORE_START))
    for p in penalties:
        raw_score = raw_score - p.cast("double")
    has_valid = F.coalesce(valid, F.lit(0)) > 0
    # a missing statistic gives no score: its penalty is unknown, not zero
    known = p95.isNotNull() & avg.isNotNull()
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw_score))
    score = F.when(~has_valid, F.lit(0.0)).when(known, bounded)
    s = s.withColumn("score", score)
    sc = F.col("score")
    grade = F.lit(V_GRADE_LAST)
    for lim, name in reversed(V_GRADES):
        grade = F.when(sc >= lim, F.lit(name)).otherwise(grade)
    s = s.withColumn("grade", F.when(~has_valid, F.lit(V_GRADE_LAST)).when(sc.isNotNull(), grade))
    s = s.withColumn("passed", has_valid & F.coalesce(sc >= V_PASS_SCORE, F.lit(False)))
    s = s.withColumn("score_int", sc.cast("bigint"))
    issues = F.array_compact(F.array(
        F.when(inv > 0, F.format_string(V_ISSUE_PARSE, inv)),
        F.when(empty > 0, F.format_string(V_ISSUE_EMPTY, empty, tx.round_even(empty_pct, 1))),
        F.when(dupc > 0, F.format_string(V_ISSUE_DUPS, dupc, dupt)),
        F.when(valid < V_VERY_SMALL_N, F.format_string(V_ISSUE_VERY_SMALL, valid))
         .when(valid < V_SMALL_N, F.format_string(V_ISSUE_SMALL, valid)),
        F.when(p95 > V_P95_LIMIT, F.format_string(V_ISSUE_P95, p95)),
        F.when(avg < V_MEAN_MIN, F.format_string(V_ISSUE_MEAN, tx.round_even(avg, 0))),
    ))
    s = s.withColumn("issues", issues)
    return s.withColumn("advice", advice_v(sc, inv, dupc, dupt, F.col(s.columns[0])))


def advice_v(score: Column, invalid: Column, dup_count: Column, total_dups: Column, name: Column) -> Column:
    """Advice lines by score band, joined by newline."""
    lit_lines = lambda xs: F.array(*[F.lit(x) for x in xs])
    good = F.array_compact(F.array(
        F.lit(V_ADVICE_GOOD),
        F.when(invalid > 0, F.format_string(V_ADVICE_GOOD_PARSE_TIP, invalid)),
        F.when(dup_count > 0, F.format_string(V_ADVICE_GOOD_DUP_TIP, total_dups)),
    ))
    lines = (
        F.when(score >= 90, F.array(F.lit(V_ADVICE_EXCELLENT[0]), F.format_string(V_ADVICE_EXCELLENT[1], name)))
        .when(score >= 75, good)
        .when(score >= 60, lit_lines(V_ADVICE_FAIR))
        .when(score >= 40, lit_lines(V_ADVICE_POOR))
        .otherwise(lit_lines(V_ADVICE_UNUSABLE))
    )
    return F.array_join(lines, "\n")


# ---- A: analyzer audit ------------------------------------------------------

def a_rows(samples: DataFrame, by: list[str]) -> DataFrame:
    """A's per-row values: full text, its length, token estimate, digest, short/control/bilingual."""
    ok = samples.filter(F.col("status") == "ok")
    full = fm.full_text_a()
    return ok.withColumn("_ta", full).select(
        *by,
        tx.char_len(F.col("_ta")).alias("chars"),
        tx.tokens_a(F.col("_ta")).alias("tokens_f"),
        F.unhex(F.md5(F.col("_ta"))).alias("text_key"),
        tx.is_short_output(fm.output_text_a()).alias("short"),
        tx.has_control(F.col("instruction")).alias("control"),
        tx.is_bilingual(F.col("_ta")).alias("bilingual"),
    )


def numpy_round(x: Column, decimals: int) -> Column:
    """``round(np.float64, d)``: rint(x · 10^d) / 10^d (differs from Python's ``round`` at ties)."""
    f = float(10 ** decimals)
    return F.rint(x.cast("double") * F.lit(f)) / F.lit(f)


def numpy_quantiles(rows: DataFrame, by: list[str], value: str, qs: dict[str, float],
                    median: str | None = None, hist: DataFrame | None = None) -> DataFrame:
    """numpy's linear percentiles (and median) per slice, exact to the last bit, from a
    (slice, value) histogram: index (n-1)·q, neighbours by running count, numpy's two-sided lerp.
    The histogram is bounded by the distinct values, never by the rows of a slice."""
    if hist is None:
        hist = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("_cum", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    n = F.col("_n")
    v = F.col(value)

    def at(k):
        return F.min(F.when(F.col("_cum") > k, v))
    aggs = [F.max("_n").alias("_n")]
    for name, q in qs.items():
        vi = (n - 1).cast("double") * F.lit(float(q))
        prev = F.floor(vi)
        aggs += [at(prev).alias(name + "__a"), at(F.least(prev + 1, n - 1)).alias(name + "__b"),
                 at(n - 1).alias(name + "__z"), F.max(vi).alias(name + "__vi")]
    if median:
        aggs += [at(F.floor((n - 1) / 2)).alias("_m1"), at(F.floor(n / 2)).alias("_m2")]
    g = h.groupBy(*by).agg(*aggs)
    out = [F.col(c) for c in by]
    for name in qs:
        a, b = F.col(name + "__a").cast("double"), F.col(name + "__b").cast("double")
        vi = F.col(name + "__vi")
        gam = vi - F.floor(vi)
        d = b - a
        val = (F.when(vi >= F.col("_n") - 1, F.col(name + "__z").cast("double"))
               .when(gam >= 0.5, b - d * (F.lit(1.0) - gam)).otherwise(a + d * gam))
        out.append(val.alias(name))
    if median:
        out.append(((F.col("_m1").cast("double") + F.col("_m2").cast("double")) / F.lit(2.0)).alias(median))
    return g.select(*out)


def length_stats(samples: DataFrame, by=("slice",)) -> DataFrame:
    """A: chars min, max, mean, median (1 dec.), P80, P95 (int); tokens median (1 dec.), P95 (int).
    Percentiles and rounding follow numpy (linear interpolation, rint-based rounding). One
    GROUPING SETS aggregation gives both histograms and the plain aggregates."""
    by = _by(by)
    r = a_rows(samples, by)
    parts = grouped_counts(r, by, ["chars", "tokens_f"],
                           [F.min("chars").alias("_min"), F.max("chars").alias("_max"),
                            F.sum("chars").alias("_sum")])
    base = parts[None].select(*by, F.col("_c").alias("total_samples"), F.col("_min").cast("bigint").alias("min_chars"),
                              F.col("_max").cast("bigint").alias("max_chars"),
                              numpy_round(F.col("_sum") / F.col("_c"), 1).alias("mean_chars"))
    qc = numpy_quantiles(None, by, "chars", {"_p80": 0.8, "_p95": 0.95}, median="_med", hist=parts["chars"])
    qt = numpy_quantiles(None, by, "tokens_f", {"_tp95": 0.95}, median="_tmed", hist=parts["tokens_f"])
    s = join_on(join_on(base, qc, by), qt, by)
    return s.select(*by, "total_samples", "min_chars", "max_chars", "mean_chars",
                    numpy_round(F.col("_med"), 1).alias("median_chars"),
                    F.col("_p80").cast("bigint").alias("p80_chars"),
                    F.col("_p95").cast("bigint").alias("p95_chars"),
                    F.col("_tp95").cast("bigint").alias("p95_tokens_est"),
                    numpy_round(F.col("_tmed"), 1).alias("median_tokens_est"))


def exact_dups(rows: DataFrame, by: list[str], key: str = "text_key") -> DataFrame:
    """n − distinct texts, via (slice, digest) counts: one shuffle of fixed-width keys."""
    g = rows.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_c"))
    return g.groupBy(*by).agg(F.sum("_c").alias("n"), (F.sum("_c") - F.count(F.lit(1))).alias("duplicate_count"))


def quality_a(samples: DataFrame, by=("slice",)) -> DataFrame:
    """A: short-output, duplicate and bilingual ratios (4 dec.), control-char count, issues."""
    by = _by(by)
    r = a_rows(samples, by)
    parts = grouped_counts(r, by, ["text_key"], [
        F.count_if("short").alias("short_count"), F.count_if("control").alias("control_count"),
        F.count_if("bilingual").alias("bilingual_count")])
    base = parts[None].select(*by, F.col("_c").alias("n"), "short_count", "control_count", "bilingual_count")
    d = parts["text_key"].groupBy(*by).agg((F.sum("_c") - F.count(F.lit(1))).alias("duplicate_count"))
    s = join_on(base, d, by)
    n = F.col("n")
    s = s.select(
        *by, "n", "short_count", "duplicate_count", "control_count", "bilingual_count",
        tx.round_even(F.col("short_count") / n, 4).alias("empty_output_ratio"),
        tx.round_even(F.col("duplicate_count") / n, 4).alias("duplicate_ratio"),
        tx.round_even(F.col("bilingual_count") / n, 4).alias("bilingual_ratio"),
        F.array_compact(F.array(
            F.when(F.col("short_count") > 0, F.format_string(A_ISSUE_SHORT, F.col("short_count"))),
            F.when(F.col("duplicate_count") > 0, F.format_string(A_ISSUE_DUPS, F.col("duplicate_count"))),
            F.when(F.col("control_count") > 0, F.format_string(A_ISSUE_CONTROL, F.col("control_count"))),
        )).alias("issues"),
    )
    return s.withColumn("has_issues", F.size("issues") > 0)


def alerts(quality: DataFrame) -> DataFrame:
    """Red flags: short outputs above 5 %, exact duplicates above 10 %."""
    return quality.withColumn("alert_short", (F.col("short_count") / F.col("n")) > ALERT_SHORT_SHARE) \
                  .withColumn("alert_dups", (F.col("duplicate_count") / F.col("n")) > ALERT_DUP_SHARE)


# ---- T: training-time checks -----------------------------------------------

def t_rows(samples: DataFrame, by: list[str], order: str = "line_no") -> DataFrame:
    first = first_records(samples, by, order)
    valid = samples.filter(F.col("status") != "bad_json")
    j = attach_small(valid, first, by, order)
    return j.withColumn("_tt", fm.full_text_t(F.col("fmt_t"))).select(
        *by, "fmt_t", tx.tokens_t(F.col("_tt")).alias("tokens"))


def truncation(samples: DataFrame, max_len: int = 2048, by=("slice",), order: str = "line_no") -> DataFrame:
    """T: rows above the max length, nearest-rank P95 (sorted[int(n*0.95)]) and whether it exceeds."""
    by = _by(by)
    r = t_rows(samples, by, order)
    hist = grouped_counts(r, by, ["tokens"])["tokens"]  # one text pass, landed; both results read it
    over = hist.groupBy(*by).agg(F.sum(F.when(F.col("tokens") > max_len, F.col("_c")).otherwise(0)).alias("over_count"))
    st = token_stats(None, by, "tokens", p99=False, hist=hist)
    return join_on(st, over, by).withColumn("p95_over", F.col("p95_tokens") > max_len).withColumn(
        "max_len", F.lit(max_len))


def audit_report(samples: DataFrame, by=("slice",), order: str = "line_no") -> DataFrame:
    """One row per slice holding both reports: the analyzer part (``length``, ``quality``,
    ``format``) and the validator part (``passed``, ``stats``, ``issues``, ``advice``)."""
    by = _by(by)
    v = v_audit(samples, by, order)
    ln = length_stats(samples, by)
    q = quality_a(samples, by)
    first = first_records(samples, by, order)
    length = F.struct(F.col("min_chars").alias("min"), F.col("max_chars").alias("max"),
                      F.col("mean_chars").alias("mean"), F.col("median_chars").alias("median"),
                      F.col("p80_chars").alias("percentile_80"), F.col("p95_chars").alias("percentile_95"),
                      F.col("total_samples"), F.col("p95_tokens_est").alias("estimated_p95_tokens"),
                      F.col("median_tokens_est").alias("estimated_median_tokens"))
    quality = F.struct("has_issues", F.col("issues").alias("issues"), "empty_output_ratio", "duplicate_ratio",
                       "bilingual_ratio")
    quality_cols = q.select(*by, "has_issues", "issues", "empty_output_ratio", "duplicate_ratio", "bilingual_ratio")
    a = (join_on(join_on(ln, quality_cols, by), first.select(*by, "fmt_a", "first_keys"), by, "left")
         .select(*by, length.alias("length"), quality.alias("quality"),
                 F.struct(F.col("fmt_a").alias("format"), F.col("first_keys").alias("fields")).alias("format")))
    stats = F.struct("total_lines", "valid_lines", "invalid_lines", "detected_format", "key_fields", "empty_count",
                     "dup_count", "total_duplicates", tx.round_even("avg_tokens", 1).alias("avg_tokens"),
                     "p50_tokens", "p95_tokens", "p99_tokens", tx.round_even("score", 1).alias("score"), "grade")
    vv = v.select(*by, "passed", stats.alias("stats"), "issues", "advice")
    return join_on(vv, a, by, "left")
