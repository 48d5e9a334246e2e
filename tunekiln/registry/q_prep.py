"""Templates and prompts (§2.2), filters (§2.3), windows (§2.6), top-k (§2.7), scalar rules (§2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import text as tx
from ..operators import audit as au
from ..operators import evalset as ev
from ..operators import prep
from ..sources import fixtures as fx
from ..sources.lines import number_rows
from .common import (D_JSONL, D_PAIRS, d_blank, d_cjk, d_fp, d_key, d_short, d_strip, d_tokens_f, d_tokens_t,
                     d_tokens_v, register)
from ..functions.text import CJK_CLASS_T

NL = "chr(10)"
D_DEFECTS = D_PAIRS + """,
defects AS (
  SELECT conv_id, turn,
         CASE WHEN conv_id % 5 = 0 THEN instruction || chr(9) ELSE instruction END AS instruction,
         CASE WHEN conv_id % 7 = 0 THEN '' WHEN conv_id % 11 = 0 THEN 'ok'
              WHEN conv_id % 13 = 0 THEN NULL ELSE output END AS output
  FROM pairs)
"""
D_CJK = """
cm AS (
  SELECT doc_id AS sample_id, source AS slice,
         CASE doc_id % 6 WHEN 1 THEN text || '中文测试' WHEN 2 THEN text || 'カタカナ' WHEN 3 THEN text || '한국어'
              WHEN 4 THEN text || chr(131072) || chr(131073) WHEN 5 THEN '汉字文本' ELSE text END AS text
  FROM documents)
"""


# ---- templates and prompts --------------------------------------------------

@register("prj_tpl_instruction", sql="WITH " + D_PAIRS + """
SELECT conv_id, turn, '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Response:' || chr(10)
       || output AS text FROM pairs""")
def prj_tpl_instruction(spark, sf):
    """``### Instruction:\\n{i}\\n\\n### Response:\\n{o}`` over user→assistant pairs."""
    p = fx.pairs(spark, sf)
    return p.select("conv_id", "turn", fm.tpl_instruction("instruction", "output").alias("text"))


@register("prj_tpl_chatml", sql="""
SELECT conv_id AS sample_id, string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, ''), chr(10)
       ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def prj_tpl_chatml(spark, sf):
    """Messages rendered as ``<|role|>\\ncontent`` turns joined by newline."""
    m = fx.messages_records(spark, sf)
    return m.select("sample_id", fm.tpl_chatml("messages").alias("text"))


@register("prj_tpl_conversations", sql="""
SELECT conv_id AS sample_id, string_agg('<|' || CASE WHEN conv_id % 2 = 1 AND role = 'assistant' THEN 'bot' ELSE role END
       || '|>' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def prj_tpl_conversations(spark, sf):
    """``{from, value}`` turns rendered with role ← from, content ← value."""
    c = fx.conversations_records(spark, sf)
    return c.select("sample_id", fm.tpl_chatml("conversations", conversations=True).alias("text"))


@register("prj_tpl_auto", sql="WITH " + D_JSONL + """
SELECT slice, sample_id,
       CASE WHEN messages IS NOT NULL OR (coalesce(k_instruction AND k_output, false)) THEN 'ok' ELSE 'unsupported' END AS tpl_status,
       CASE WHEN messages IS NOT NULL THEN array_to_string(list_transform(messages, lambda m: '<|' ||
                 coalesce(json_extract_string(m, '$.role'), 'user') || '|>' || chr(10) ||
                 coalesce(json_extract_string(m, '$.content'), '')), chr(10))
            WHEN coalesce(k_instruction AND k_output, false) THEN '### Instruction:' || chr(10) || coalesce(instruction, '')
                 || chr(10) || chr(10) || '### Response:' || chr(10) || coalesce(output, '') END AS text
FROM js WHERE status <> 'bad_json'""")
def prj_tpl_auto(spark, sf):
    """Per-row template: messages → instruction-output → conversations; other rows are
    ``unsupported`` (the reference raises)."""
    s = fx.jsonl_samples(spark, sf).filter(F.col("status") != "bad_json")
    t = fm.tpl_auto()
    return s.select("slice", "sample_id", F.when(t.isNotNull(), "ok").otherwise("unsupported").alias("tpl_status"),
                    t.alias("text"))


@register("prj_tpl_cpt", sql="SELECT doc_id AS sample_id, text FROM documents")
def prj_tpl_cpt(spark, sf):
    """CPT rows pass ``text`` through with no template."""
    return fx.text_records(spark, sf).select("sample_id", fm.tpl_cpt().alias("text"))


@register("prj_prompt", sql="WITH " + D_PAIRS + """
SELECT conv_id, turn, '<|user|>' || chr(10) || instruction || chr(10) || '<|assistant|>' || chr(10) AS prompt_chat,
       '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Response:' || chr(10) AS prompt_instruction
FROM pairs""")
def prj_prompt(spark, sf):
    """Inference/eval prompt for chat formats and for instruction data."""
    p = fx.pairs(spark, sf)
    return p.select("conv_id", "turn", fm.prompt(F.lit("messages"), F.col("instruction")).alias("prompt_chat"),
                    fm.prompt(F.lit("instruction-output"), F.col("instruction")).alias("prompt_instruction"))


@register("prj_strip_prompt", sql=f"""
WITH c AS (SELECT item_id, text, '### Instruction:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10) AS p
           FROM benchmark)
SELECT item_id, text AS base_clean, {d_strip('text')} AS tuned_clean FROM c""")
def prj_strip_prompt(spark, sf):
    """Model responses with the echoed prompt removed (first len(prompt) chars, then strip)."""
    e = fx.eval_outputs(spark, sf)
    return e.select("item_id", fm.strip_prompt("base_raw", "formatted_prompt").alias("base_clean"),
                    fm.strip_prompt("tuned_raw", "formatted_prompt").alias("tuned_clean"))


# ---- filters ----------------------------------------------------------------

@register("flt_blank_lines", sql="WITH " + D_JSONL + """
SELECT slice, count(*) AS n_lines, count(*) FILTER (WHERE raw <> '') AS n_nonblank FROM jl1 GROUP BY slice""")
def flt_blank_lines(spark, sf):
    """Lines per slice before and after dropping lines that are empty after strip."""
    l = fx.jsonl_lines(spark, sf)
    return l.groupBy("slice").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~tx.is_blank("raw")).alias("n_nonblank"))


@register("flt_short_output", sql="WITH " + D_DEFECTS + f"""
SELECT conv_id, turn, output FROM defects WHERE {d_short('output')}""")
def flt_short_output(spark, sf):
    """Rows whose stripped output is shorter than 5 characters (null counts as '')."""
    d = fx.defects(spark, sf)
    return d.filter(tx.is_short_output("output")).select("conv_id", "turn", "output")


@register("flt_empty_field", sql="WITH " + D_DEFECTS + f"""
SELECT conv_id, turn, f.field, f.reason FROM (
  SELECT conv_id, turn, [
    {{'field': 'instruction', 'reason': CASE WHEN instruction IS NULL THEN 'missing/None'
                                        WHEN {d_blank('instruction')} THEN 'empty string' END}},
    {{'field': 'output', 'reason': CASE WHEN output IS NULL THEN 'missing/None'
                                   WHEN {d_blank('output')} THEN 'empty string' END}}] AS fs
  FROM defects), unnest(fs) AS u(f) WHERE f.reason IS NOT NULL""")
def flt_empty_field(spark, sf):
    """Per (record, key field): missing/None, empty string or empty list, with the reason."""
    d = fx.defects(spark, sf)
    fields = F.array(F.struct(F.lit("instruction").alias("field"), au.empty_reason("instruction").alias("reason")),
                     F.struct(F.lit("output").alias("field"), au.empty_reason("output").alias("reason")))
    x = d.select("conv_id", "turn", F.explode(fields).alias("f"))
    return x.filter(F.col("f.reason").isNotNull()).select("conv_id", "turn", "f.field", "f.reason")


@register("flt_control_chars", sql="WITH " + D_DEFECTS + """
SELECT conv_id, turn FROM defects WHERE coalesce(regexp_matches(instruction, '[\\t\\r\\x00]'), false)""")
def flt_control_chars(spark, sf):
    """Rows whose instruction holds a tab, carriage return or NUL."""
    d = fx.defects(spark, sf)
    return d.filter(tx.has_control("instruction")).select("conv_id", "turn")


@register("flt_bilingual", sql="WITH " + D_CJK + """
SELECT sample_id, coalesce(regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') AND regexp_matches(text, '[A-Za-z]'), false)
       AS is_bilingual FROM cm""")
def flt_bilingual(spark, sf):
    """Han character and ASCII letter in the same text."""
    return fx.cjk_mix(spark, sf).select("sample_id", tx.is_bilingual("text").alias("is_bilingual"))


@register("flt_over_length", sql=f"""
SELECT doc_id, {d_tokens_v('text')} AS tokens FROM documents WHERE {d_tokens_v('text')} > 2048""")
def flt_over_length(spark, sf):
    """Documents whose V token estimate exceeds a max length of 2048."""
    d = fx.table(spark, sf, "documents").select("doc_id", tx.tokens_v("text").alias("tokens"))
    return d.filter(tx.is_over_length("tokens", 2048))


@register("flt_clean", sql="WITH " + D_DEFECTS + f""",
turns AS (SELECT conv_id, count(*) AS n, coalesce(max_by(text, turn) FILTER (WHERE role = 'assistant'), '') AS reply
          FROM conversations GROUP BY conv_id)
SELECT 'defects' AS slice, conv_id * 1000 + turn AS sample_id FROM defects
WHERE NOT {d_blank('instruction')} AND NOT {d_blank('output')} AND NOT {d_short('output')}
UNION ALL SELECT 'messages', conv_id FROM turns WHERE n > 0 AND NOT {d_short('reply')}
UNION ALL SELECT 'conversations', conv_id FROM turns WHERE n > 0 AND NOT {d_short('reply')}
UNION ALL SELECT source, doc_id FROM documents WHERE NOT {d_blank('text')}""")
def flt_clean(spark, sf):
    """Rows of every format kept after dropping bad JSON, empty key fields and short replies."""
    records = [fx.defects(spark, sf), fx.messages_records(spark, sf, "messages"), fx.conversations_records(spark, sf), fx.text_records(spark, sf)]
    kept = [prep.clean(r).select("slice", "sample_id") for r in records]
    return kept[0].unionByName(kept[1]).unionByName(kept[2]).unionByName(kept[3])


# ---- windows ------------------------------------------------------------------

@register("win_keep_first", sql=f"""
WITH g AS (SELECT source AS slice, {d_key('text')} AS k, doc_id FROM documents)
SELECT slice, min(doc_id) AS doc_id, count(*) AS group_size FROM g GROUP BY slice, k""")
def win_keep_first(spark, sf):
    """First document (smallest id) of each group with the same whole normalised text per source."""
    d = fx.table(spark, sf, "documents").select(F.col("source").alias("slice"), "doc_id", "text")
    k = prep.keep_first(d.select("slice", "doc_id", tx.text_key("text").alias("key")), "key", "doc_id", ["slice"])
    return k.select("slice", "doc_id", "group_size")


@register("win_split", sql="""
WITH r AS (SELECT source AS slice, doc_id,
                  row_number() OVER (PARTITION BY source ORDER BY md5('42|' || CAST(doc_id AS VARCHAR))) AS rk,
                  count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT slice, doc_id, CASE WHEN rk <= ceil(0.1::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM r""")
def win_split(spark, sf):
    """Exact 10 % test split per source by md5('42|id') rank."""
    d = fx.table(spark, sf, "documents").select(F.col("source").alias("slice"), "doc_id")
    return prep.split(d, "doc_id", ["slice"]).select("slice", "doc_id", "split")


@register("win_split_given", sql="""
WITH p AS (SELECT source AS slice, doc_id, CASE WHEN CAST(replace(source, 'src', '') AS INT) % 3 = 0 AND doc_id % 7 = 0 THEN 'eval'
                  WHEN CAST(replace(source, 'src', '') AS INT) % 3 = 1 AND doc_id % 11 = 0 THEN 'test' ELSE 'train' END AS part FROM documents),
r AS (SELECT slice, doc_id, part, bool_or(part <> 'train') OVER (PARTITION BY slice) AS given,
             row_number() OVER (PARTITION BY slice ORDER BY md5('42|' || CAST(doc_id AS VARCHAR))) AS rk,
             count(*) OVER (PARTITION BY slice) AS n FROM p)
SELECT slice, doc_id, CASE WHEN CASE WHEN given THEN part <> 'train' ELSE rk <= ceil(0.1::DOUBLE * n) END THEN 'test' ELSE 'train' END AS split FROM r""")
def win_split_given(spark, sf):
    """The split of documents with a given part: sources that have a test or eval part keep it, the others are
    split anew."""
    number = F.col("slice").substr(F.lit(4), F.lit(9)).cast("int")
    part = (F.when((number % 3 == 0) & (F.col("doc_id") % 7 == 0), "eval").when((number % 3 == 1) & (F.col("doc_id") % 11 == 0), "test").otherwise("train"))
    d = fx.table(spark, sf, "documents").select(F.col("source").alias("slice"), "doc_id").withColumn("part", part)
    return prep.split(d, "doc_id", ["slice"], existing="part").select("slice", "doc_id", "split")


PACK_SEQ = 2048
PACK_IDS = 300  # ids of a shard here: several shards at every scale
D_PACK = f"""
pt AS (SELECT doc_id // {PACK_IDS} AS shard, doc_id AS sample_id, {d_tokens_v('text')} + 1 AS sample_len FROM documents),
pc AS (SELECT *, CAST(sum(sample_len) OVER (PARTITION BY shard ORDER BY sample_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e,
              CAST(sum(sample_len) OVER (PARTITION BY shard) AS BIGINT) AS shard_total FROM pt),
pp AS (SELECT shard, sample_id, sample_len, e - sample_len AS s, e, shard_total,
              unnest(range((e - sample_len) // {PACK_SEQ}, (e - 1) // {PACK_SEQ} + 1)) AS pack FROM pc),
pieces AS (SELECT shard, pack, sample_id, greatest(s, pack * {PACK_SEQ}) - s AS piece_start,
                  least(e, (pack + 1) * {PACK_SEQ}) - greatest(s, pack * {PACK_SEQ}) AS piece_len,
                  greatest(s, pack * {PACK_SEQ}) - pack * {PACK_SEQ} AS pack_offset, sample_len,
                  (pack + 1) * {PACK_SEQ} <= shard_total AS is_full FROM pp)
"""


def _pieces(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", tx.tokens_v("text").alias("tokens"))
    return prep.pack(d, "doc_id", "tokens", PACK_SEQ, prep.range_shard("doc_id", PACK_IDS))


@register("win_pack", sql="WITH " + D_PACK + " SELECT * FROM pieces")
def win_pack(spark, sf):
    """Documents (+1 end-of-text token each) packed into 2048-token sequences; a shard is a fixed range
    of ids."""
    return _pieces(spark, sf)


@register("win_pack_continuous", sql=f"""
WITH t AS (SELECT source AS slice, doc_id AS sample_id, {d_tokens_v('text')} + 1 AS sample_len FROM documents),
c AS (SELECT *, CAST(sum(sample_len) OVER (PARTITION BY slice ORDER BY sample_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e,
             CAST(sum(sample_len) OVER (PARTITION BY slice) AS BIGINT) AS total FROM t),
p AS (SELECT slice, sample_id, sample_len, e - sample_len AS s, e, total,
             unnest(range((e - sample_len) // {PACK_SEQ}, (e - 1) // {PACK_SEQ} + 1)) AS pack FROM c)
SELECT slice, pack, sample_id, greatest(s, pack * {PACK_SEQ}) - s AS piece_start,
       least(e, (pack + 1) * {PACK_SEQ}) - greatest(s, pack * {PACK_SEQ}) AS piece_len,
       greatest(s, pack * {PACK_SEQ}) - pack * {PACK_SEQ} AS pack_offset, sample_len, (pack + 1) * {PACK_SEQ} <= total AS is_full FROM p""")
def win_pack_continuous(spark, sf):
    """Documents of each source packed in one row of 2048-token sequences, by a two-level prefix sum over ranges of
    ids: at most one pack a source is part-filled."""
    d = fx.table(spark, sf, "documents").select(F.col("source").alias("slice"), "doc_id", tx.tokens_v("text").alias("tokens"))
    return prep.pack_continuous(d, "doc_id", "tokens", PACK_SEQ, ["slice"])


@register("win_pack_segments", sql="WITH " + D_PACK + """
SELECT shard, pack, count(*) AS n_segments, CAST(sum(piece_len) AS BIGINT) AS used, bool_and(is_full) AS is_full,
       string_agg(CAST(sample_id AS VARCHAR) || ':' || CAST(pack_offset AS VARCHAR) || ':' || CAST(piece_len AS VARCHAR), ';'
                  ORDER BY pack_offset) AS segments
FROM pieces GROUP BY shard, pack""")
def win_pack_segments(spark, sf):
    """Per pack: ordered segments (sample:offset:length) — position ids restart at each offset."""
    seg = prep.pack_segments(_pieces(spark, sf))
    return seg.select("shard", "pack", F.size("segments").cast("bigint").alias("n_segments"), "used", "is_full",
                      F.array_join(F.transform("segments", lambda s: F.concat_ws(
                          ":", s["sample_id"].cast("string"), s["pack_offset"].cast("string"),
                          s["piece_len"].cast("string"))), ";").alias("segments"))


@register("win_pack_gain", sql=f"""
WITH t AS (SELECT source AS slice, doc_id // {PACK_IDS} AS s, {d_tokens_v('text')} AS tok FROM documents),
ps AS (SELECT slice, s, count(*) AS n, sum(tok) AS tok, ceil((sum(tok) + count(*)) / {PACK_SEQ}) AS packs FROM t GROUP BY 1, 2),
g AS (SELECT slice, CAST(sum(n) AS BIGINT) AS n, CAST(sum(tok) AS BIGINT) AS total_tokens, CAST(sum(packs) AS BIGINT) AS n_packs
      FROM ps GROUP BY slice)
SELECT slice, n, total_tokens, n_packs, round_even(total_tokens / n, 6) AS mean_tokens,
       round_even(total_tokens / (n * {PACK_SEQ}), 6) AS fill_padded,
       round_even((total_tokens + n) / (n_packs * {PACK_SEQ}), 6) AS fill_packed,
       round_even(n / n_packs, 6) AS speedup,
       CASE WHEN total_tokens / n > 2048 THEN 'no' WHEN total_tokens / n < 500 AND {PACK_SEQ} >= 4096 THEN 'yes'
            ELSE 'maybe' END AS suitable
FROM g""")
def win_pack_gain(spark, sf):
    """Padded vs packed fill rate and packing suitability per source."""
    d = fx.table(spark, sf, "documents").select(F.col("source").alias("slice"), "doc_id",
                                                tx.tokens_v("text").alias("tokens"))
    g = prep.pack_gain(d, ["slice"], "tokens", PACK_SEQ, prep.range_shard("doc_id", PACK_IDS))
    return g.select("slice", "n", "total_tokens", F.col("n_packs").cast("bigint").alias("n_packs"), "mean_tokens",
                    "fill_padded", "fill_packed", "speedup", "suitable")


@register("win_last_assistant", sql="""
SELECT conv_id, coalesce(max_by(text, turn) FILTER (WHERE role = 'assistant'), '') AS last_reply
FROM conversations GROUP BY conv_id""")
def win_last_assistant(spark, sf):
    """Last assistant turn of each conversation from the long turn table ('' when none)."""
    c = fx.table(spark, sf, "conversations")
    a = F.col("role") == "assistant"
    return c.groupBy("conv_id").agg(F.coalesce(F.max_by(F.when(a, F.col("text")), F.when(a, F.col("turn"))),
                                               F.lit("")).alias("last_reply"))


# ---- top-k --------------------------------------------------------------------

D_CASES = """
cases AS (SELECT item_id, text AS instruction,
                 '### Instruction:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10) AS formatted_prompt
          FROM benchmark ORDER BY item_id LIMIT {k})
"""


@register("top_eval_100", sql="WITH " + D_CASES.format(k=100) + " SELECT * FROM cases")
def top_eval_100(spark, sf):
    """First 100 test cases in line order with their prompts."""
    b = fx.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("instruction"))
    return ev.eval_cases(b, "item_id", "instruction-output", ev.EVAL_MAX_CASES).select(
        "item_id", "instruction", "formatted_prompt")


@register("agg_eval_metrics", sql="WITH " + D_CASES.format(k=100) + """
SELECT count(*) AS total_test_cases, round_even(avg(length(formatted_prompt)), 1) AS avg_instruction_length FROM cases""")
def agg_eval_metrics(spark, sf):
    """Case count (first 100) and mean formatted-prompt length."""
    b = fx.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("instruction"))
    return ev.eval_metrics(ev.eval_cases(b, "item_id", "instruction-output", ev.EVAL_MAX_CASES))


@register("top_compare_50", sql="WITH " + D_CASES.format(k=50) + f"""
SELECT item_id, instruction, instruction AS base_model_output, {d_strip('instruction')} AS lora_model_output
FROM cases""")
def top_compare_50(spark, sf):
    """First 50 cases with base and tuned outputs side by side."""
    from .q_sources import _eval_rows
    r = _eval_rows(spark, sf).orderBy("item_id").limit(ev.COMPARE_MAX_CASES)
    return r.select("item_id", "instruction", "base_model_output", "lora_model_output")


@register("top_empty_details", sql="WITH " + D_DEFECTS + f""",
v AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS line FROM defects),
d AS (SELECT v.line, f.pos, 'Line ' || CAST(v.line AS VARCHAR) || ': field ''' || f.field || ''' is ' || f.reason AS detail
      FROM (SELECT conv_id, turn, [
              {{'pos': 1, 'field': 'instruction', 'reason': CASE WHEN instruction IS NULL THEN 'missing/None'
                                                 WHEN {d_blank('instruction')} THEN 'empty string' END}},
              {{'pos': 2, 'field': 'output', 'reason': CASE WHEN output IS NULL THEN 'missing/None'
                                            WHEN {d_blank('output')} THEN 'empty string' END}}] AS fs FROM defects) x,
           unnest(fs) AS u(f), v WHERE v.conv_id = x.conv_id AND v.turn = x.turn AND f.reason IS NOT NULL)
SELECT detail FROM d ORDER BY line, pos LIMIT 10""")
def top_empty_details(spark, sf):
    """First 10 empty-field findings as V prints them (``Line N`` counts valid records)."""
    d = fx.defects(spark, sf)
    d = number_rows(d, "sample_id", out="line")
    fields = F.array(
        F.struct(F.lit(1).alias("pos"), F.lit("instruction").alias("field"), au.empty_reason("instruction").alias("reason")),
        F.struct(F.lit(2).alias("pos"), F.lit("output").alias("field"), au.empty_reason("output").alias("reason")))
    x = d.select("line", F.explode(fields).alias("f")).filter(F.col("f.reason").isNotNull())
    x = x.select("line", "f.pos", F.format_string("Line %d: field '%s' is %s", F.col("line"), F.col("f.field"),
                                                  F.col("f.reason")).alias("detail"))
    return x.orderBy("line", "pos").limit(10).select("detail")


@register("top_samples", sql="""
SELECT slice, doc_id, rank, text FROM (SELECT source AS slice, doc_id, text,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 3""")
def top_samples(spark, sf):
    """First 3 records of each slice (partial top-k before the shuffle)."""
    d = fx.table(spark, sf, "documents").select(F.col("source").alias("slice"), "doc_id", "text")
    return prep.top_k_per_group(d, ["slice"], [F.col("doc_id")], 3).select(
        "slice", "doc_id", F.col("rank").cast("bigint").alias("rank"), "text")


# ---- scalar rules -------------------------------------------------------------

@register("fn_char_len", sql="WITH " + D_CJK + " SELECT sample_id, CAST(length(text) AS INT) AS char_len FROM cm")
def fn_char_len(spark, sf):
    """Code points per text (supplementary characters count once)."""
    return fx.cjk_mix(spark, sf).select("sample_id", tx.char_len("text").alias("char_len"))


@register("fn_cjk_count", sql="WITH " + D_CJK + f" SELECT sample_id, CAST({d_cjk('text')} AS INT) AS cjk FROM cm")
def fn_cjk_count(spark, sf):
    """CJK characters (Han, Ext A, kana, hangul, Ext B)."""
    return fx.cjk_mix(spark, sf).select("sample_id", tx.cjk_count("text").alias("cjk"))


@register("fn_cjk_count_t", sql="WITH " + D_CJK + f" SELECT sample_id, CAST({d_cjk('text', CJK_CLASS_T)} AS INT) AS cjk_t FROM cm")
def fn_cjk_count_t(spark, sf):
    """CJK characters under T's narrower class (Han and Ext A only)."""
    return fx.cjk_mix(spark, sf).select("sample_id", tx.cjk_count_t("text").alias("cjk_t"))


@register("fn_tokens_a", sql="WITH " + D_CJK + f" SELECT sample_id, {d_tokens_f('text')} AS tokens_a FROM cm")
def fn_tokens_a(spark, sf):
    """2.0 per CJK character + 0.3 per other character, as a float."""
    return fx.cjk_mix(spark, sf).select("sample_id", tx.tokens_a("text").alias("tokens_a"))


@register("fn_tokens_v", sql="WITH " + D_CJK + f" SELECT sample_id, {d_tokens_v('text')} AS tokens_v, {d_tokens_t('text')} AS tokens_t FROM cm")
def fn_tokens_v(spark, sf):
    """The estimate truncated to an integer (V), and T's variant."""
    return fx.cjk_mix(spark, sf).select("sample_id", tx.tokens_v("text").alias("tokens_v"),
                                        tx.tokens_t("text").alias("tokens_t"))


@register("fn_strip", sql=f"""
WITH w AS (SELECT doc_id, chr(12288) || chr(160) || ' ' || text || chr(9) || chr(11) || chr(8233) AS t FROM documents)
SELECT doc_id, {d_strip('t')} AS stripped FROM w""")
def fn_strip(spark, sf):
    """Python ``str.strip`` on texts wrapped in Unicode white space (U+3000, U+00A0, tab, VT, U+2029)."""
    d = fx.table(spark, sf, "documents")
    t = F.concat(F.lit("\u3000\u00a0 "), F.col("text"), F.lit("\t\x0b\u2029"))
    return d.select("doc_id", tx.py_strip(t).alias("stripped"))


@register("fn_fingerprint", sql=f"""
WITH nd AS (SELECT doc_id, text FROM documents UNION ALL
            SELECT doc_id + 1000000000, chr(9) || replace(text, ' ', '  ') FROM documents WHERE doc_id % 10 = 0)
SELECT doc_id, {d_fp('text')} AS fp FROM nd""")
def fn_fingerprint(spark, sf):
    """Lower case, all white space removed, first 200 characters."""
    return fx.near_dup_docs(spark, sf).select("doc_id", tx.fingerprint("text").alias("fp"))


@register("fn_seq_len", sql=f"""
SELECT doc_id, CASE WHEN r > 8192 THEN least(r, 16384) ELSE r END AS seq_len FROM (
  SELECT doc_id, greatest(512, ({d_tokens_v('text')} // 512 + 1) * 512) AS r FROM documents)""")
def fn_seq_len(spark, sf):
    """max(512, (p//512+1)·512), capped at 16384, applied to each document's token estimate."""
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", tx.seq_len_from_p95(tx.tokens_v("text")).alias("seq_len"))


@register("fn_round_even", sql="SELECT doc_id, round_even(n_chars / 4, 1) AS quarter_chars FROM documents")
def fn_round_even(spark, sf):
    """Half-to-even rounding (n_chars/4 hits .25/.75 ties)."""
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", tx.round_even(F.col("n_chars") / F.lit(4), 1).alias("quarter_chars"))
