"""Audit aggregates (§2.5): V validator statistics and score, A analyzer statistics, T checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import text as tx
from ..functions.joins import join_on
from ..operators import audit as au
from ..session import land
from ..sources import fixtures as fx
from .common import (D_PAIRS, d_blank, d_fp, d_np_median, d_np_quantile, d_np_round, d_rank, d_short, d_strip,
                     d_tokens_f, d_tokens_t, d_tokens_v, register)

ORDER = "sample_id"


def corpus(spark, sf, materialize: bool = False, replies: bool = False) -> DataFrame:
    """Four slice families as canonical samples: documents (text records, or with ``replies``
    instruction/output records, whose text the analyzer reads; one slice per source),
    conversations (messages), user→assistant pairs, and defect-injected pairs. Deriving them
    from the tables is cheap, so they are not landed (``materialize`` lands them as Parquet);
    JSON-lines inputs are landed once by ``api.load_jsonl`` because parsing is not cheap."""
    docs = fx.reply_records(spark, sf) if replies else fx.text_records(spark, sf).drop("lang")
    p = fx.pairs(spark, sf)  # one pairing plan feeds both the clean and the defect slice
    parts = [docs, fx.messages_records(spark, sf), fx.pair_records(spark, sf, pairs_df=p).drop("conv_id", "turn"),
             fx.defects(spark, sf, pairs_df=p).drop("conv_id", "turn")]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    return land(u, "corpus") if materialize else u


# DuckDB: the same four slice families with V's text and empty-field count per row.
D_CORPUS_V = D_PAIRS + f""",
defects AS (
  SELECT conv_id, turn,
         CASE WHEN conv_id % 5 = 0 THEN instruction || chr(9) ELSE instruction END AS instruction,
         CASE WHEN conv_id % 7 = 0 THEN '' WHEN conv_id % 11 = 0 THEN 'ok'
              WHEN conv_id % 13 = 0 THEN NULL ELSE output END AS output
  FROM pairs),
vtext AS (
  SELECT source AS slice, doc_id AS sid, coalesce(text, '') AS t,
         CAST({d_blank('text')} AS INT) AS n_empty FROM documents
  UNION ALL
  SELECT 'conversations', conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn), 0
  FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT 'pairs', conv_id * 1000 + turn, coalesce(instruction, '') || coalesce(output, ''),
         CAST({d_blank('instruction')} AS INT) + CAST({d_blank('output')} AS INT) FROM pairs
  UNION ALL
  SELECT 'defects', conv_id * 1000 + turn, coalesce(instruction, '') || coalesce(output, ''),
         CAST({d_blank('instruction')} AS INT) + CAST({d_blank('output')} AS INT) FROM defects),
rv AS (SELECT slice, sid, {d_fp('t')} AS fp, {d_tokens_v('t')} AS tokens, n_empty FROM vtext),
vtok AS (
  SELECT slice, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS total_tokens, avg(tokens) AS avg_tokens,
         list_sort(list(tokens)) AS s, CAST(sum(n_empty) AS BIGINT) AS empty_count
  FROM rv GROUP BY slice),
vdup AS (
  SELECT slice, count(*) FILTER (WHERE c > 1) AS dup_count,
         CAST(coalesce(sum(c - 1) FILTER (WHERE c > 1), 0) AS BIGINT) AS total_duplicates
  FROM (SELECT slice, fp, count(*) AS c FROM rv GROUP BY slice, fp) GROUP BY slice),
vstat AS (
  SELECT t.slice, t.n AS valid_lines, t.total_tokens, t.avg_tokens, t.empty_count,
         {d_rank('s', 'n', None)} AS p50_tokens, {d_rank('s', 'n', 0.95)} AS p95_tokens,
         {d_rank('s', 'n', 0.99)} AS p99_tokens, d.dup_count, d.total_duplicates,
         CAST(0 AS BIGINT) AS invalid_lines
  FROM vtok t JOIN vdup d ON t.slice IS NOT DISTINCT FROM d.slice),
vscore AS (
  SELECT *, greatest(0.0, least(100.0,
      100.0::DOUBLE
      - (CASE WHEN invalid_lines > 0 THEN least(30, invalid_lines * 2) ELSE 0 END)::DOUBLE
      - (CASE WHEN empty_count > 0 THEN least(25.0::DOUBLE, empty_count / valid_lines * 100 * 5.0::DOUBLE) ELSE 0 END)::DOUBLE
      - (CASE WHEN dup_count > 0 THEN least(20.0::DOUBLE, total_duplicates / valid_lines * 100 * 2.0::DOUBLE) ELSE 0 END)::DOUBLE
      - (CASE WHEN valid_lines < 100 THEN 15 WHEN valid_lines < 500 THEN 5 ELSE 0 END)::DOUBLE
      - (CASE WHEN p95_tokens > 4096 THEN 10 ELSE 0 END)::DOUBLE
      - (CASE WHEN avg_tokens < 50 THEN 10 ELSE 0 END)::DOUBLE)) AS score
  FROM vstat)
"""


def _v_audit(spark, sf):
    return au.v_audit(corpus(spark, sf), by=["slice"], order=ORDER)


@register("agg_score_v", sql="WITH " + D_CORPUS_V + """
SELECT slice, valid_lines, invalid_lines, empty_count, dup_count, total_duplicates,
       round_even(avg_tokens, 6) AS avg_tokens, p50_tokens, p95_tokens, p99_tokens,
       round_even(score, 6) AS score, CAST(trunc(score) AS BIGINT) AS score_int,
       CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair'
            WHEN score >= 40 THEN 'Poor' ELSE 'Unusable' END AS grade,
       score >= 60 AS passed
FROM vscore""")
def agg_score_v(spark, sf):
    """Flagship: V audit per slice — tokens, near-duplicates, empties, score, grade, passed."""
    s = _v_audit(spark, sf)
    return s.select("slice", "valid_lines", "invalid_lines", "empty_count", "dup_count", "total_duplicates",
                    tx.round_even("avg_tokens", 6).alias("avg_tokens"), "p50_tokens", "p95_tokens", "p99_tokens",
                    tx.round_even("score", 6).alias("score"), "score_int", "grade", "passed")


@register("agg_token_stats", sql="WITH " + D_CORPUS_V + """
SELECT slice, valid_lines AS n, total_tokens, round_even(avg_tokens, 6) AS avg_tokens,
       p50_tokens, p95_tokens, p99_tokens FROM vstat""")
def agg_token_stats(spark, sf):
    """Mean and nearest-rank P50/P95/P99 of V token estimates, from a token histogram."""
    c = corpus(spark, sf)
    rows = au._v_rows(c, ["slice"], ORDER)
    hist = au.grouped_counts(rows, ["slice"], ["tokens"])["tokens"]  # one text pass, landed
    t = au.token_stats(None, ["slice"], "tokens", hist=hist)
    return t.select("slice", "n", "total_tokens", tx.round_even("avg_tokens", 6).alias("avg_tokens"),
                    "p50_tokens", "p95_tokens", "p99_tokens")


D_NEAR = f"""
nd AS (
  SELECT doc_id, source, text FROM documents
  UNION ALL
  SELECT doc_id + 1000000000, source, chr(9) || replace(text, ' ', '  ') FROM documents WHERE doc_id % 10 = 0),
g AS (SELECT source AS slice, {d_fp('text')} AS fp, count(*) AS c FROM nd GROUP BY 1, 2)
"""


@register("agg_near_dups", sql="WITH " + D_NEAR + """
SELECT slice, count(*) FILTER (WHERE c > 1) AS dup_count,
       CAST(coalesce(sum(c - 1) FILTER (WHERE c > 1), 0) AS BIGINT) AS total_duplicates,
       CAST(sum(c) AS BIGINT) AS n
FROM g GROUP BY slice""")
def agg_near_dups(spark, sf):
    """Groups sharing the 200-character fingerprint, per source, on documents plus
    white-space-altered copies."""
    d = fx.near_dup_docs(spark, sf).select(F.col("source").alias("slice"), tx.fingerprint("text").alias("fp"))
    parts = au.grouped_counts(d, ["slice"], ["fp"])  # one fingerprint pass, landed
    nd = au.near_dups(None, ["slice"], "fp", parts["fp"])
    n = parts[None].select("slice", F.col("_c").alias("n"))
    return join_on(nd, n, "slice").select("slice", "dup_count", "total_duplicates", "n")


@register("agg_empty_fields", sql="WITH " + D_CORPUS_V + """
SELECT slice, empty_count, valid_lines,
       round_even(empty_count / valid_lines * 100, 4) AS empty_pct FROM vstat""")
def agg_empty_fields(spark, sf):
    """Empty (record, key field) pairs and their share of valid records (can exceed 100 %)."""
    s = _v_audit(spark, sf)
    return s.select("slice", "empty_count", "valid_lines",
                    tx.round_even(F.col("empty_count") / F.col("valid_lines") * 100, 4).alias("empty_pct"))


@register("agg_issues_v", sql="WITH " + D_CORPUS_V + """
SELECT slice, array_to_string(list_filter([
  CASE WHEN invalid_lines > 0 THEN printf('%d JSON parse error(s)', invalid_lines) END,
  CASE WHEN empty_count > 0 THEN printf('%d empty/missing field(s) (%.1f%%)', empty_count,
       round_even(empty_count / valid_lines * 100, 1)) END,
  CASE WHEN dup_count > 0 THEN printf('%d near-duplicate group(s) (%d total duplicate samples)', dup_count, total_duplicates) END,
  CASE WHEN valid_lines < 100 THEN printf('Very small dataset (%d samples, recommend  500)', valid_lines)
       WHEN valid_lines < 500 THEN printf('Small dataset (%d samples, 1000+ recommended)', valid_lines) END,
  CASE WHEN p95_tokens > 4096 THEN printf('P95 token length (%d) exceeds typical max_seq_length (4096)', p95_tokens) END,
  CASE WHEN avg_tokens < 50 THEN printf('Average token length too short (%.0f), may lack sufficient training signal', round_even(avg_tokens, 0)) END
  ], lambda x: x IS NOT NULL), ' | ') AS issues
FROM vstat""")
def agg_issues_v(spark, sf):
    """V's ordered issue strings per slice."""
    s = _v_audit(spark, sf)
    return s.select("slice", F.array_join("issues", " | ").alias("issues"))


@register("agg_advice_v", sql="WITH " + D_CORPUS_V + """
SELECT slice, CASE
  WHEN score >= 90 THEN '[OK] Data quality looks great! Ready for fine-tuning.' || chr(10) || 'Suggested: build a training plan for ' || slice || ' (plan_full)'
  WHEN score >= 75 THEN '[OK] Good enough for fine-tuning. Minor issues won''t hurt much.'
       || CASE WHEN invalid_lines > 0 THEN chr(10) || printf('Tip: Fix %d parse errors for cleaner training.', invalid_lines) ELSE '' END
       || CASE WHEN dup_count > 0 THEN chr(10) || printf('Tip: %d duplicates found. Some duplication is fine for SFT.', total_duplicates) ELSE '' END
  WHEN score >= 60 THEN '[WARN] Trainable but quality could be better.' || chr(10) || 'Fix: Check and fix the issues listed above, then re-run validation.'
  WHEN score >= 40 THEN '[WARN] Significant quality issues. Training may produce poor results.' || chr(10) || 'Fix: Review your data preparation pipeline.' || chr(10) || 'Re-run with --show-issues for detailed diagnostics.'
  ELSE '[FAIL] Data quality is too poor for meaningful training.' || chr(10)
       || 'Fix: Re-check your data source. Ensure proper JSONL format:' || chr(10)
       || '  {"instruction": "...", "output": "..."}' || chr(10)
       || '  {"messages": [{"role": "user", "content": "..."}, ...]}' || chr(10)
       || '  {"text": "..."}  (for CPT/pretraining)' END AS advice
FROM vscore""")
def agg_advice_v(spark, sf):
    """Advice lines by score band."""
    return _v_audit(spark, sf).select("slice", "advice")


# ---- A analyzer -------------------------------------------------------------

D_A_ROWS = f"""
atext AS (
  SELECT source AS slice, coalesce(lang, '') || ' ' || coalesce(text, '') AS t, coalesce(text, '') AS o, lang AS ins FROM documents
  UNION ALL
  SELECT 'conversations', string_agg(coalesce(text, ''), ' ' ORDER BY turn),
         coalesce(max_by(text, turn) FILTER (WHERE role = 'assistant'), ''), NULL
  FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT 'pairs', coalesce(instruction, '') || ' ' || coalesce(output, ''), coalesce(output, ''), instruction FROM pairs
  UNION ALL
  SELECT 'defects', coalesce(instruction, '') || ' ' || coalesce(output, ''), coalesce(output, ''), instruction FROM defects),
ar AS (
  SELECT slice, length(t) AS chars, {d_tokens_f('t')} AS tokens_f, md5(t) AS k,
         {d_short('o')} AS short, coalesce(regexp_matches(ins, '[\\t\\r\\x00]'), false) AS control,
         coalesce(regexp_matches(t, '[\\x{{4E00}}-\\x{{9FFF}}]') AND regexp_matches(t, '[A-Za-z]'), false) AS bilingual
  FROM atext)
"""
D_CORPUS_A = D_PAIRS + """,
defects AS (
  SELECT conv_id, turn,
         CASE WHEN conv_id % 5 = 0 THEN instruction || chr(9) ELSE instruction END AS instruction,
         CASE WHEN conv_id % 7 = 0 THEN '' WHEN conv_id % 11 = 0 THEN 'ok'
              WHEN conv_id % 13 = 0 THEN NULL ELSE output END AS output
  FROM pairs),""" + D_A_ROWS


def a_corpus(spark, sf) -> DataFrame:
    return corpus(spark, sf, replies=True)


@register("agg_length_stats", sql="WITH " + D_CORPUS_A + f"""
, al AS (SELECT slice, count(*) AS n, min(chars) AS min_chars, max(chars) AS max_chars, avg(chars) AS mean_c,
                list_sort(list(chars)) AS sc, list_sort(list(tokens_f)) AS st FROM ar GROUP BY slice)
SELECT slice, n AS total_samples, min_chars, max_chars, {d_np_round('mean_c', 1)} AS mean_chars,
       {d_np_round(d_np_median('sc', 'n'), 1)} AS median_chars,
       CAST(trunc({d_np_quantile('sc', 'n', 0.8)}) AS BIGINT) AS p80_chars,
       CAST(trunc({d_np_quantile('sc', 'n', 0.95)}) AS BIGINT) AS p95_chars,
       CAST(trunc({d_np_quantile('st', 'n', 0.95)}) AS BIGINT) AS p95_tokens_est,
       {d_np_round(d_np_median('st', 'n'), 1)} AS median_tokens_est
FROM al""")
def agg_length_stats(spark, sf):
    """A: character-length and token-estimate distribution per slice (numpy-linear percentiles)."""
    return au.length_stats(a_corpus(spark, sf), ["slice"])


@register("agg_quality_a", sql="WITH " + D_CORPUS_A + """
, q AS (SELECT slice, count(*) AS n, count(*) FILTER (WHERE short) AS short_count,
               count(*) - count(DISTINCT k) AS duplicate_count,
               count(*) FILTER (WHERE control) AS control_count,
               count(*) FILTER (WHERE bilingual) AS bilingual_count FROM ar GROUP BY slice)
SELECT slice, n, short_count, duplicate_count, control_count, bilingual_count,
       round_even(short_count / n, 4) AS empty_output_ratio,
       round_even(duplicate_count / n, 4) AS duplicate_ratio,
       round_even(bilingual_count / n, 4) AS bilingual_ratio,
       array_to_string(list_filter([
         CASE WHEN short_count > 0 THEN printf('发现 %d 条回复过短（< 5 字符），可能是生成失败', short_count) END,
         CASE WHEN duplicate_count > 0 THEN printf('发现 %d 条完全重复数据，建议去重', duplicate_count) END,
         CASE WHEN control_count > 0 THEN printf('发现 %d 条包含控制字符（\\t \\r \\x00），可能影响解析', control_count) END
       ], lambda x: x IS NOT NULL), ' | ') AS issues
FROM q""")
def agg_quality_a(spark, sf):
    """A: short-output / duplicate / bilingual ratios, control-character count and issue texts."""
    q = au.quality_a(a_corpus(spark, sf), ["slice"])
    return q.select("slice", "n", "short_count", "duplicate_count", "control_count", "bilingual_count",
                    "empty_output_ratio", "duplicate_ratio", "bilingual_ratio",
                    F.array_join("issues", " | ").alias("issues"))


D_ALERTS = """,
alert AS (SELECT slice, count(*) AS n, count(*) FILTER (WHERE short) AS short_count,
                 count(*) - count(DISTINCT k) AS duplicate_count FROM ar GROUP BY slice)
"""


@register("agg_alerts", sql="WITH " + D_CORPUS_A + D_ALERTS + """
SELECT slice, n, short_count, duplicate_count, short_count / n > 0.05 AS alert_short,
       duplicate_count / n > 0.10 AS alert_dups FROM alert""")
def agg_alerts(spark, sf):
    """Red flags per slice: short outputs above 5 %, exact duplicates above 10 %."""
    q = au.alerts(au.quality_a(a_corpus(spark, sf), ["slice"]))
    return q.select("slice", "n", "short_count", "duplicate_count", "alert_short", "alert_dups")


@register("agg_quality_level", sql="WITH " + D_CORPUS_V + "," + D_A_ROWS + D_ALERTS + """
SELECT vscore.slice, CASE WHEN score < 60 THEN 'fail'
                   WHEN dup_count > 0 OR empty_count > 0 OR valid_lines < 500 OR p95_tokens > 4096 OR avg_tokens < 50
                        OR short_count / n > 0.05 OR duplicate_count / n > 0.10
                   THEN 'warn' ELSE 'good' END AS quality_level
FROM vscore JOIN alert ON vscore.slice IS NOT DISTINCT FROM alert.slice""")
def agg_quality_level(spark, sf):
    """good / warn / fail per slice: fail if the V score < 60 or the valid share < 0.90, warn if any
    V issue or alert, else good."""
    s = _v_audit(spark, sf)
    al = au.alerts(au.quality_a(a_corpus(spark, sf), ["slice"])).select("slice", (F.col("alert_short") | F.col("alert_dups")).alias("alert"))
    s = join_on(s, al, "slice", "left")
    valid_share = F.col("valid_lines") / (F.col("valid_lines") + F.col("invalid_lines"))
    lvl = (F.when((F.col("score") < au.V_PASS_SCORE) | (valid_share < au.VALID_SHARE_MIN), F.lit("fail"))
           .when((F.size("issues") > 0) | F.coalesce("alert", F.lit(False)), F.lit("warn")).otherwise(F.lit("good")))
    return s.select("slice", lvl.alias("quality_level"))


@register("agg_exact_dups", sql="""
SELECT source AS slice, count(*) AS n, count(*) - count(DISTINCT md5(text)) AS duplicate_count,
       count(*) - count(DISTINCT md5(coalesce(lang, '') || ' ' || coalesce(text, ''))) AS duplicate_count_a
FROM documents GROUP BY source""")
def agg_exact_dups(spark, sf):
    """n − distinct texts per source on raw document text, and A's count on instruction/output records."""
    d = fx.table(spark, sf, "documents").select(F.col("source").alias("slice"),
                                                F.unhex(F.md5("text")).alias("k"))
    raw = au.exact_dups(d, ["slice"], "k")
    r = au.a_rows(fx.reply_records(spark, sf), ["slice"])
    a = au.exact_dups(r, ["slice"]).select("slice", F.col("duplicate_count").alias("duplicate_count_a"))
    return join_on(raw, a, "slice").select("slice", "n", "duplicate_count", "duplicate_count_a")


@register("agg_cjk_mix_a", sql=f"""
WITH m AS (
  SELECT source AS slice,
         CASE doc_id % 6 WHEN 1 THEN text || '中文测试' WHEN 2 THEN text || 'カタカナ' WHEN 3 THEN text || '한국어'
              WHEN 4 THEN text || chr(131072) || chr(131073) WHEN 5 THEN '汉字文本' ELSE text END AS t
  FROM documents)
SELECT slice, count(*) AS n,
       count(*) FILTER (WHERE coalesce(regexp_matches(t, '[\\x{{4E00}}-\\x{{9FFF}}]') AND regexp_matches(t, '[A-Za-z]'), false)) AS bilingual_count,
       CAST(sum({d_tokens_v('t')}) AS BIGINT) AS tokens_v, CAST(sum({d_tokens_t('t')}) AS BIGINT) AS tokens_t,
       round_even(sum({d_tokens_f('t')}), 4) AS tokens_a
FROM m GROUP BY slice""")
def agg_cjk_mix_a(spark, sf):
    """Bilingual count and the three token estimates over documents with CJK, kana, hangul and
    Extension-B text injected (rule families A, V, T side by side)."""
    m = fx.cjk_mix(spark, sf)
    return m.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(tx.is_bilingual("text")).alias("bilingual_count"),
        F.sum(tx.tokens_v("text")).alias("tokens_v"),
        F.sum(tx.tokens_t("text")).alias("tokens_t"),
        tx.round_even(F.sum(tx.tokens_a("text")), 4).alias("tokens_a"),
    )


@register("agg_role_tokens", sql=f"""
SELECT role, count(*) AS n_rows, CAST(sum({d_tokens_v('text')}) AS BIGINT) AS tokens,
       role <> 'system' AS bears_loss
FROM conversations GROUP BY role""")
def agg_role_tokens(spark, sf):
    """Rows and V tokens per role (system tokens are counted but bear no loss)."""
    t = fx.table(spark, sf, "conversations").select("role", tx.tokens_v(F.col("text")).alias("tok"))
    return t.groupBy("role").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("tok").alias("tokens"),
                                 (F.col("role") != "system").alias("bears_loss"))


@register("agg_cpt_volume", sql=f"""
SELECT source AS slice, CAST(sum({d_tokens_v('text')}) AS BIGINT) AS total_tokens,
       sum({d_tokens_v('text')}) > 10000000 AS enough_for_cpt
FROM documents GROUP BY source""")
def agg_cpt_volume(spark, sf):
    """Total estimated CPT tokens per slice and the > 10 M check."""
    d = fx.text_records(spark, sf)
    return d.groupBy("slice").agg(F.sum(tx.tokens_v("text")).alias("total_tokens")).withColumn(
        "enough_for_cpt", F.col("total_tokens") > 10_000_000)


@register("agg_truncation", sql="WITH " + D_PAIRS + f""",
t AS (SELECT 'pairs' AS slice, {d_tokens_t("coalesce(instruction, '') || coalesce(output, '')")} AS tokens FROM pairs
      UNION ALL
      SELECT 'conversations', {d_tokens_t('tx')} FROM (
        SELECT string_agg(coalesce(text, ''), '' ORDER BY turn) AS tx FROM conversations GROUP BY conv_id)
      UNION ALL
      SELECT source, {d_tokens_t('text')} FROM documents),
s AS (SELECT slice, count(*) AS n, list_sort(list(tokens)) AS l, count(*) FILTER (WHERE tokens > 512) AS over_count,
             avg(tokens) AS avg_tokens FROM t GROUP BY slice)
SELECT slice, n, over_count, {d_rank('l', 'n', 0.95)} AS p95_tokens, {d_rank('l', 'n', 0.95)} > 512 AS p95_over,
       round_even(avg_tokens, 6) AS avg_tokens
FROM s""")
def agg_truncation(spark, sf):
    """T: rows above max length 512 and whether T's P95 exceeds it."""
    parts = [fx.pair_records(spark, sf).drop("conv_id", "turn"), fx.messages_records(spark, sf),
             fx.text_records(spark, sf).drop("lang")]
    c = reduce(lambda a, b: a.unionByName(b), parts)
    t = au.truncation(c, 512, ["slice"], ORDER)
    return t.select("slice", "n", "over_count", "p95_tokens", "p95_over",
                    tx.round_even("avg_tokens", 6).alias("avg_tokens"))


@register("agg_train_time", sql="WITH " + D_PAIRS + f""",
t AS (SELECT 'pairs' AS slice, {d_tokens_t("coalesce(instruction, '') || coalesce(output, '')")} AS tokens FROM pairs
      UNION ALL SELECT source, {d_tokens_t('text')} FROM documents),
s AS (SELECT slice, count(*) AS n, avg(tokens) AS avg_tokens FROM t GROUP BY slice),
p AS (SELECT slice, n, avg_tokens,
             CASE WHEN n < 500 THEN 5 WHEN n < 5000 THEN 3 WHEN n < 20000 THEN 2 ELSE 1 END AS epochs,
             4 * 4 AS eff_batch FROM s)
SELECT slice, n, epochs, eff_batch,
       round_even(n * avg_tokens * epochs / (2000 * eff_batch), 4) AS minutes,
       round_even(n * avg_tokens * epochs / (2000 * eff_batch) * 0.7, 4) AS minutes_low,
       round_even(n * avg_tokens * epochs / (2000 * eff_batch) * 1.3, 4) AS minutes_high
FROM p""")
def agg_train_time(spark, sf):
    """Minutes = lines × mean tokens × epochs / (2000 × effective batch), with ×0.7 / ×1.3 band
    (epochs by rule R7 for chat; batch 4 × accumulation 4)."""
    from ..plans import rules
    parts = [fx.pair_records(spark, sf).drop("conv_id", "turn"), fx.text_records(spark, sf).drop("lang")]
    c = reduce(lambda a, b: a.unionByName(b), parts)
    r = au.t_rows(c, ["slice"], ORDER)
    s = r.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.avg("tokens").alias("avg_tokens"))
    s = s.withColumn("epochs", rules.epochs(F.col("n"), F.lit("chat"))).withColumn("eff_batch", F.lit(16))
    return rules.train_time(s).select("slice", "n", "epochs", "eff_batch", "minutes", "minutes_low", "minutes_high")


ROLLUP_SCORE = """greatest(0.0, least(100.0, 100.0::DOUBLE
      - (CASE WHEN invalid_lines > 0 THEN least(30, invalid_lines * 2) ELSE 0 END)::DOUBLE
      - (CASE WHEN empty_count > 0 THEN least(25.0::DOUBLE, empty_count / n * 100 * 5.0::DOUBLE) ELSE 0 END)::DOUBLE
      - (CASE WHEN dup_count > 0 THEN least(20.0::DOUBLE, total_duplicates / n * 100 * 2.0::DOUBLE) ELSE 0 END)::DOUBLE
      - (CASE WHEN n < 100 THEN 15 WHEN n < 500 THEN 5 ELSE 0 END)::DOUBLE
      - (CASE WHEN p95_tokens > 4096 THEN 10 ELSE 0 END)::DOUBLE
      - (CASE WHEN avg_tokens < 50 THEN 10 ELSE 0 END)::DOUBLE))"""


@register("agg_slices_rollup", sql=f"""
WITH r AS (SELECT source, lang, coalesce(text, '') AS t, CAST({d_blank('text')} AS INT) AS n_empty FROM documents),
v AS (SELECT source, lang, {d_tokens_v('t')} AS tokens, length(t) AS chars, {d_fp('t')} AS fp, md5(t) AS k, n_empty FROM r),
x AS (SELECT l.level, CASE WHEN l.level < 3 THEN source END AS source, CASE WHEN l.level = 0 THEN lang END AS lang, tokens, chars, fp, k, n_empty
      FROM v, (VALUES (0), (1), (3)) AS l(level)),
g AS (SELECT level, source, lang, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS total_tokens, avg(tokens) AS avg_tokens,
             list_sort(list(tokens)) AS st, list_sort(list(chars)) AS sc, CAST(sum(n_empty) AS BIGINT) AS empty_count,
             count(*) - count(DISTINCT k) AS duplicate_count, CAST(0 AS BIGINT) AS invalid_lines FROM x GROUP BY 1, 2, 3),
f AS (SELECT level, source, lang, count(*) FILTER (WHERE c > 1) AS dup_count, CAST(coalesce(sum(c - 1) FILTER (WHERE c > 1), 0) AS BIGINT) AS total_duplicates
      FROM (SELECT level, source, lang, fp, count(*) AS c FROM x GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
s AS (SELECT g.*, f.dup_count, f.total_duplicates, {d_rank('st', 'n', None)} AS p50_tokens, {d_rank('st', 'n', 0.95)} AS p95_tokens, {d_rank('st', 'n', 0.99)} AS p99_tokens
      FROM g JOIN f ON g.level = f.level AND g.source IS NOT DISTINCT FROM f.source AND g.lang IS NOT DISTINCT FROM f.lang),
z AS (SELECT *, {ROLLUP_SCORE} AS score FROM s)
SELECT source, lang, CAST(level AS INT) AS level, n, total_tokens, round_even(avg_tokens, 6) AS avg_tokens, sc[n] AS max_chars,
       p50_tokens, p95_tokens, p99_tokens, round_even({d_np_median('sc', 'n')}, 6) AS median_chars,
       round_even({d_np_quantile('sc', 'n', 0.95)}, 6) AS p95_chars, duplicate_count, dup_count, total_duplicates, empty_count,
       round_even(score, 6) AS score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair'
            WHEN score >= 40 THEN 'Poor' ELSE 'Unusable' END AS grade, score >= 60 AS passed
FROM z""")
def agg_slices_rollup(spark, sf):
    """The whole audit per (source, lang), per source and in total from one text pass: percentiles, exact and near
    duplicates, empties, score and grade."""
    a = au.audit_rollup(fx.text_records(spark, sf), ["slice", "lang"])
    return a.select(F.col("slice").alias("source"), "lang", "level", F.col("valid_lines").alias("n"), "total_tokens", tx.round_even("avg_tokens", 6).alias("avg_tokens"),
                    "max_chars", "p50_tokens", "p95_tokens", "p99_tokens", tx.round_even("median_chars", 6).alias("median_chars"),
                    tx.round_even("p95_chars", 6).alias("p95_chars"), "duplicate_count", "dup_count", "total_duplicates", "empty_count",
                    tx.round_even("score", 6).alias("score"), "grade", "passed")
