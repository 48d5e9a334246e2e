"""Sources and sinks (§2.1), parse-level aggregates and JSONL projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import text as tx
from ..functions.joins import join_on
from ..operators import audit as au
from ..operators import evalset as ev
from ..operators import prep
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import sinks
from ..sources.lines import multiset_digest, read_lines, read_question_parts, slice_of_path, sorted_digest
from ..sources.records import map_aliases, parse_lines
from .common import (D_JSONL, D_PAIRS, d_fp, d_np_quantile, d_np_round, d_rank, d_short, d_strip, d_tokens_f,
                     d_tokens_v, register)

ORDER = "line_no"


def _jsonl(spark, sf, with_nb=False):
    return fx.jsonl_samples(spark, sf, with_nb=with_nb)


@register("src_jsonl_lines", sql="WITH " + D_JSONL + """
SELECT slice, count(*) AS n_lines, count(DISTINCT raw) AS n_distinct, CAST(sum(length(raw)) AS BIGINT) AS chars,
       md5(concat_ws('|', count(raw), """ + ", ".join(f"sum(('0x' || substr(md5(raw), {1 + 8 * i}, 8))::UBIGINT)" for i in range(4)) + """)) AS lines_digest,
       md5(string_agg(md5(raw), '' ORDER BY md5(raw))) AS lines_md5
FROM jl1 WHERE raw <> '' GROUP BY slice""")
def src_jsonl_lines(spark, sf):
    """The JSON-lines fixture written as text files (a folder per slice) and read back as numbered lines.

    Line numbers follow the files, whose borders depend on the writer; the result has what does not: the
    lines of each slice, named by its folder, with an order-free digest of them and one of their sorted digests,
    after a check that every file is numbered without a gap."""
    path = scratch_path(spark, "jsonl")
    sinks.write_jsonl_lines(fx.jsonl_lines(spark, sf), path)
    lines = read_lines(spark, path + "/*/*.txt")
    files = lines.groupBy("slice").agg(F.max("nb_no").alias("last"), F.count(F.lit(1)).alias("n"), F.countDistinct("nb_no").alias("d"),
                                       F.count_if(F.col("line_no") < F.col("nb_no")).alias("odd"))
    folder = slice_of_path(F.col("slice"))
    sound = files.groupBy(folder.alias("slice")).agg(F.bool_and((F.col("last") == F.col("n")) & (F.col("d") == F.col("n")) & (F.col("odd") == 0)).alias("sound"))
    per = lines.groupBy(folder.alias("slice")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.countDistinct(F.unhex(F.md5("raw"))).alias("n_distinct"),
        F.sum(F.length("raw")).cast("bigint").alias("chars"), multiset_digest(F.col("raw")).alias("lines_digest"))
    counts = lines.groupBy(folder.alias("slice"), F.md5("raw").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    per = join_on(per, sorted_digest(counts, "slice", "k", "n", "lines_md5"), "slice")
    return join_on(per, sound.filter("sound"), "slice").drop("sound")


@register("src_json_parse", sql="WITH " + D_JSONL + "SELECT slice, sample_id, line_no, status FROM js")
def src_json_parse(spark, sf):
    """Strict JSON parse of each non-blank line: ok | bad_json | not_object."""
    return _jsonl(spark, sf).select("slice", "sample_id", "line_no", "status")


@register("src_parse_errors", sql="WITH " + D_JSONL + """,
bad AS (SELECT slice, line_no, nb_no, row_number() OVER (PARTITION BY slice ORDER BY line_no) AS rk FROM js
        WHERE status = 'bad_json')
SELECT slice, count(*) AS n_bad,
       string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (WHERE rk <= 3) AS first3_lines,
       string_agg(CAST(nb_no AS VARCHAR), ',' ORDER BY nb_no) FILTER (WHERE rk <= 5) AS first5_nonblank,
       string_agg(CAST(nb_no AS VARCHAR), ',' ORDER BY nb_no) FILTER (WHERE rk <= 10) AS first10_nonblank
FROM bad GROUP BY slice""")
def src_parse_errors(spark, sf):
    """Bad-line count per slice and the first 3 physical (A), 5 and 10 non-blank (V, T) numbers."""
    s = _jsonl(spark, sf, with_nb=True)
    return au_parse_errors(s)


def au_parse_errors(s):
    bad = s.filter(F.col("status") == "bad_json").select("slice", "line_no", "nb_no")
    n = bad.groupBy("slice").agg(F.count(F.lit(1)).alias("n_bad"))
    top = prep.top_k_per_group(bad, ["slice"], [F.col("line_no")], 10)
    lst = top.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("line_no", "nb_no"))).alias("_l"))

    def first(k, field):
        return F.array_join(F.transform(F.slice("_l", 1, k), lambda x: x[field].cast("string")), ",")
    lst = lst.select("slice", first(3, "line_no").alias("first3_lines"), first(5, "nb_no").alias("first5_nonblank"),
                     first(10, "nb_no").alias("first10_nonblank"))
    return join_on(n, lst, "slice")


@register("src_typed_records", sql="WITH " + D_JSONL + """
SELECT slice, sample_id,
       CASE WHEN k_messages THEN 'messages' WHEN k_instruction AND k_output THEN 'instruction-output'
            WHEN k_conversations THEN 'conversations' WHEN k_text THEN 'text' ELSE 'unknown' END AS fmt,
       instruction, output, text, CAST(len(messages) AS INT) AS n_messages
FROM js WHERE status = 'ok'""")
def src_typed_records(spark, sf):
    """Valid object lines → canonical columns; a missing key gives null."""
    s = _jsonl(spark, sf).filter(F.col("status") == "ok")
    return s.select("slice", "sample_id", fm.fmt_canonical().alias("fmt"), "instruction", "output", "text",
                    F.size("messages").alias("n_messages")).withColumn(
        "n_messages", F.when(F.col("n_messages") >= 0, F.col("n_messages")))


@register("src_field_alias", sql="""
WITH a AS (
  SELECT doc_id AS sample_id,
         CASE doc_id % 4 WHEN 0 THEN CAST(to_json({'prompt': lang, 'completion': text}) AS VARCHAR)
              WHEN 1 THEN CAST(to_json({'question': lang, 'answer': text}) AS VARCHAR)
              WHEN 2 THEN CAST(to_json({'input': lang, 'target': text}) AS VARCHAR)
              ELSE CAST(to_json({'text': lang, 'summary': text}) AS VARCHAR) END AS raw
  FROM documents)
SELECT sample_id,
       coalesce(json_extract_string(raw, '$.instruction'), json_extract_string(raw, '$.prompt'),
                json_extract_string(raw, '$.question'), json_extract_string(raw, '$.input'),
                json_extract_string(raw, '$.text')) AS instruction,
       coalesce(json_extract_string(raw, '$.output'), json_extract_string(raw, '$.completion'),
                json_extract_string(raw, '$.answer'), json_extract_string(raw, '$.target'),
                json_extract_string(raw, '$.summary')) AS output
FROM a""")
def src_field_alias(spark, sf):
    """prompt/completion, question/answer, input/target, text/summary → instruction/output."""
    return map_aliases(parse_lines(fx.alias_lines(spark, sf)), keep=["sample_id"])


@register("src_fold_turns", sql="""
SELECT conv_id, CAST(count(*) AS INT) AS n_turns, string_agg(role, ',' ORDER BY turn) AS roles,
       arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role,
       CAST(sum(length(text)) AS BIGINT) AS chars
FROM conversations GROUP BY conv_id""")
def src_fold_turns(spark, sf):
    """Long turn table → one ordered turns array per conversation."""
    f = fx.fold_turns(fx.table(spark, sf, "conversations"))
    return f.select("conv_id", F.size("turns").alias("n_turns"),
                    F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"),
                    F.element_at("turns", 1)["role"].alias("first_role"),
                    F.element_at("turns", -1)["role"].alias("last_role"),
                    F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + F.length(t["text"])).alias("chars"))


@register("src_pair_turns", sql="WITH " + D_PAIRS + " SELECT conv_id, turn, instruction, output FROM pairs")
def src_pair_turns(spark, sf):
    """Each assistant turn right after a user turn → instruction/output."""
    return fx.pairs(spark, sf)


@register("src_question_lines", sql=f"""
SELECT row_number() OVER (ORDER BY item_id) AS q_no, {d_strip("replace(replace(text, chr(13), ' '), chr(10), ' ')")} AS question
FROM benchmark""")
def src_question_lines(spark, sf):
    """benchmark texts written as a question file in part files by ranges of ids, line breaks as blanks, and read back: one question a
    line, numbered from 1."""
    path = scratch_path(spark, "questions")
    line = F.translate("text", "\r\n", "  ")
    fx.table(spark, sf, "benchmark").select("item_id", line.alias("text")).repartitionByRange("item_id").sortWithinPartitions(
        "item_id").select("text").write.text(path)
    return read_question_parts(spark, path).select("q_no", "question")


# ---- parse-level aggregates -------------------------------------------------

@register("agg_parse_counts", sql="WITH " + D_JSONL + """
SELECT slice, count(*) AS total_lines, count(*) FILTER (WHERE status <> 'bad_json') AS valid_lines,
       count(*) FILTER (WHERE status = 'bad_json') AS invalid_lines FROM js GROUP BY slice""")
def agg_parse_counts(spark, sf):
    """Total, valid and invalid non-blank lines per slice."""
    return au.parse_counts(_jsonl(spark, sf), ["slice"])


@register("agg_valid_share", sql="WITH " + D_JSONL + """
SELECT slice, round_even(count(*) FILTER (WHERE status <> 'bad_json') / count(*), 6) AS valid_share,
       count(*) FILTER (WHERE status <> 'bad_json') / count(*) >= 0.90 AS valid_ok FROM js GROUP BY slice""")
def agg_valid_share(spark, sf):
    """Share of lines that are valid JSON, and the ≥ 0.90 check."""
    c = au.parse_counts(_jsonl(spark, sf), ["slice"])
    share = F.col("valid_lines") / F.col("total_lines")
    return c.select("slice", tx.round_even(share, 6).alias("valid_share"),
                    (share >= au.VALID_SHARE_MIN).alias("valid_ok"))


D_FMT = D_JSONL + """,
jf AS (
  SELECT *, CASE WHEN status <> 'ok' THEN 'unknown'
                 WHEN coalesce(k_messages, false) THEN 'messages'
                 WHEN coalesce(k_instruction AND k_output, false) THEN 'instruction-output'
                 WHEN coalesce(k_conversations, false) THEN 'conversations'
                 WHEN coalesce(k_text, false) THEN 'text (CPT/pretraining)' ELSE 'unknown' END AS fmt_v,
            CASE WHEN status <> 'ok' THEN 'unknown'
                 WHEN messages IS NOT NULL THEN 'chat'
                 WHEN coalesce(k_instruction AND k_output, false) THEN 'instruction-output'
                 WHEN coalesce(k_conversations, false) THEN 'conversations' ELSE 'unknown' END AS fmt_a
  FROM js WHERE status <> 'bad_json'),
ff AS (SELECT slice, arg_min(fmt_v, line_no) AS first_fmt_v, arg_min(fmt_a, line_no) AS first_fmt_a,
              arg_min(CASE WHEN status = 'ok' THEN json_keys(raw) ELSE []::VARCHAR[] END, line_no) AS first_keys
       FROM jf GROUP BY slice)
"""


@register("agg_format_mix", sql="WITH " + D_FMT + """,
per AS (SELECT slice, CASE WHEN coalesce(k_messages, false) THEN 'messages'
                           WHEN coalesce(k_instruction AND k_output, false) THEN 'instruction-output'
                           WHEN coalesce(k_conversations, false) THEN 'conversations'
                           WHEN coalesce(k_text, false) THEN 'text' ELSE 'unknown' END AS fmt, count(*) AS n
        FROM js WHERE status = 'ok' GROUP BY 1, 2),
nf AS (SELECT slice, count(*) AS n_formats FROM per GROUP BY slice)
SELECT per.slice, fmt, n, n_formats, first_fmt_a, first_fmt_v FROM per JOIN nf ON per.slice IS NOT DISTINCT FROM nf.slice
LEFT JOIN ff ON per.slice IS NOT DISTINCT FROM ff.slice""")
def agg_format_mix(spark, sf):
    """Per slice and format: count, number of formats, and the first record's A and V format."""
    return au.format_mix(_jsonl(spark, sf), ["slice"], ORDER)


@register("prj_format_a", sql="WITH " + D_FMT + " SELECT slice, sample_id, fmt_a FROM jf")
def prj_format_a(spark, sf):
    """A's per-record format label (chat, instruction-output, conversations, unknown)."""
    s = _jsonl(spark, sf).filter(F.col("status") != "bad_json")
    return s.select("slice", "sample_id", F.when(F.col("status") == "ok", fm.fmt_a()).otherwise(
        F.lit(fm.FMT_UNKNOWN)).alias("fmt_a"))


@register("prj_format_v", sql="WITH " + D_FMT + """
SELECT slice, sample_id, fmt_v, CASE WHEN fmt_v = 'text (CPT/pretraining)' THEN 'cpt (text)' ELSE fmt_v END AS fmt_t FROM jf""")
def prj_format_v(spark, sf):
    """V's and T's per-record format label from key presence."""
    s = _jsonl(spark, sf).filter(F.col("status") != "bad_json")
    ok = F.col("status") == "ok"
    return s.select("slice", "sample_id", F.when(ok, fm.fmt_v()).otherwise(F.lit(fm.FMT_UNKNOWN)).alias("fmt_v"),
                    F.when(ok, fm.fmt_t()).otherwise(F.lit(fm.FMT_UNKNOWN)).alias("fmt_t"))


@register("prj_key_fields", sql="WITH " + D_FMT + """
SELECT slice, first_fmt_v AS detected_format,
       CASE first_fmt_v WHEN 'messages' THEN 'messages' WHEN 'instruction-output' THEN 'instruction,output'
            WHEN 'conversations' THEN 'conversations' WHEN 'text (CPT/pretraining)' THEN 'text'
            ELSE array_to_string(first_keys, ',') END AS key_fields
FROM ff""")
def prj_key_fields(spark, sf):
    """Fields V checks per slice: by the first record's format, else all its keys."""
    f = au.first_records(_jsonl(spark, sf), ["slice"], ORDER)
    return f.select("slice", F.col("fmt_v").alias("detected_format"),
                    F.array_join(fm.key_fields_v(F.col("fmt_v"), F.col("first_keys")), ",").alias("key_fields"))


@register("prj_format_map", sql="WITH " + D_FMT + """
SELECT slice, first_fmt_a AS detected_format,
       CASE first_fmt_a WHEN 'chat' THEN 'messages' WHEN 'conversations' THEN 'conversations'
            ELSE 'instruction-output' END AS data_format FROM ff""")
def prj_format_map(spark, sf):
    """A label of the first record → pipeline format (unknown → instruction-output)."""
    f = au.first_records(_jsonl(spark, sf), ["slice"], ORDER)
    return f.select("slice", F.col("fmt_a").alias("detected_format"), fm.map_format(F.col("fmt_a")).alias("data_format"))


@register("prj_full_text_a", sql="WITH " + D_JSONL + """
SELECT slice, sample_id,
       CASE WHEN messages IS NOT NULL
            THEN array_to_string(list_transform(messages, lambda m: coalesce(json_extract_string(m, '$.content'), '')), ' ')
            ELSE coalesce(instruction, '') || ' ' || coalesce(output, '') END AS full_text
FROM js WHERE status = 'ok'""")
def prj_full_text_a(spark, sf):
    """A's full text: turns joined by one space, else instruction + ' ' + output."""
    s = _jsonl(spark, sf).filter(F.col("status") == "ok")
    return s.select("slice", "sample_id", fm.full_text_a().alias("full_text"))


@register("prj_full_text_v", sql="WITH " + D_FMT + """
SELECT jf.slice, sample_id, CASE first_fmt_v
    WHEN 'messages' THEN coalesce(array_to_string(list_transform(messages, lambda m:
         coalesce(json_extract_string(m, '$.content'), json_extract_string(m, '$.value'), '')), ''), '')
    WHEN 'instruction-output' THEN coalesce(instruction, '') || coalesce(output, '')
    WHEN 'text (CPT/pretraining)' THEN coalesce(text, '') ELSE '' END AS full_text
FROM jf JOIN ff ON jf.slice IS NOT DISTINCT FROM ff.slice""")
def prj_full_text_v(spark, sf):
    """V's text: the slice's key fields concatenated with nothing."""
    s = _jsonl(spark, sf)
    first = au.first_records(s, ["slice"], ORDER)
    j = au.attach_small(s.filter(F.col("status") != "bad_json"), first, ["slice"])
    return j.select("slice", "sample_id", fm.full_text_v(F.col("fmt_v"), F.col("first_keys")).alias("full_text"))


@register("prj_full_text_t", sql="WITH " + D_FMT + """
SELECT jf.slice, sample_id, CASE first_fmt_v
    WHEN 'messages' THEN coalesce(array_to_string(list_transform(messages, lambda m:
         coalesce(json_extract_string(m, '$.content'), json_extract_string(m, '$.value'), '')), ''), '')
    WHEN 'instruction-output' THEN
         (CASE WHEN coalesce(k_instruction, false) THEN coalesce(instruction, 'None') ELSE '' END) ||
         (CASE WHEN coalesce(k_output, false) THEN coalesce(output, 'None') ELSE '' END)
    WHEN 'text (CPT/pretraining)' THEN CASE WHEN coalesce(k_text, false) THEN coalesce(text, 'None') ELSE '' END
    ELSE '' END AS full_text
FROM jf JOIN ff ON jf.slice IS NOT DISTINCT FROM ff.slice""")
def prj_full_text_t(spark, sf):
    """T's text: like V, but a non-list value is str(value) ('None' for null)."""
    s = _jsonl(spark, sf)
    first = au.first_records(s, ["slice"], ORDER)
    j = au.attach_small(s.filter(F.col("status") != "bad_json"), first, ["slice"])
    return j.select("slice", "sample_id", fm.full_text_t(F.col("fmt_t")).alias("full_text"))


@register("prj_output_text", sql="WITH " + D_JSONL + """
SELECT slice, sample_id,
       CASE WHEN messages IS NOT NULL THEN coalesce(json_extract_string(list_filter(messages, lambda m:
                 json_extract_string(m, '$.role') = 'assistant')[-1], '$.content'), '')
            ELSE coalesce(output, '') END AS output_text
FROM js WHERE status = 'ok'""")
def prj_output_text(spark, sf):
    """A's reply text: last assistant turn, '' when none; else output."""
    s = _jsonl(spark, sf).filter(F.col("status") == "ok")
    return s.select("slice", "sample_id", fm.output_text_a().alias("output_text"))


# ---- sinks ------------------------------------------------------------------

D_JSONL_V = D_FMT + f""",
jv AS (
  SELECT jf.slice, jf.sample_id, ff.first_fmt_v,
         CASE first_fmt_v
           WHEN 'messages' THEN coalesce(array_to_string(list_transform(messages, lambda m:
                coalesce(json_extract_string(m, '$.content'), json_extract_string(m, '$.value'), '')), ''), '')
           WHEN 'instruction-output' THEN coalesce(instruction, '') || coalesce(output, '')
           WHEN 'text (CPT/pretraining)' THEN coalesce(text, '') ELSE '' END AS t,
         CASE first_fmt_v
           WHEN 'messages' THEN CAST(messages IS NULL OR len(messages) = 0 AS INT)
           WHEN 'instruction-output' THEN CAST(instruction IS NULL OR {{blank_i}} AS INT) + CAST(output IS NULL OR {{blank_o}} AS INT)
           WHEN 'text (CPT/pretraining)' THEN CAST(text IS NULL OR {{blank_t}} AS INT)
           ELSE 0 END AS n_empty
  FROM jf JOIN ff ON jf.slice IS NOT DISTINCT FROM ff.slice),
jr AS (SELECT slice, {d_fp('t')} AS fp, {d_tokens_v('t')} AS tokens, n_empty FROM jv),
jc AS (SELECT slice, count(*) AS total_lines, count(*) FILTER (WHERE status <> 'bad_json') AS valid_lines,
              count(*) FILTER (WHERE status = 'bad_json') AS invalid_lines FROM js GROUP BY slice),
jt AS (SELECT slice, count(*) AS n, avg(tokens) AS avg_tokens, list_sort(list(tokens)) AS s,
              CAST(sum(n_empty) AS BIGINT) AS empty_count FROM jr GROUP BY slice),
jd AS (SELECT slice, count(*) FILTER (WHERE c > 1) AS dup_count,
              CAST(coalesce(sum(c - 1) FILTER (WHERE c > 1), 0) AS BIGINT) AS total_duplicates
       FROM (SELECT slice, fp, count(*) AS c FROM jr GROUP BY 1, 2) GROUP BY slice),
ja AS (SELECT jc.*, ff.first_fmt_v AS detected_format, jt.avg_tokens, jt.empty_count,
              {d_rank('jt.s', 'jt.n', 0.95)} AS p95_tokens, jd.dup_count, jd.total_duplicates
       FROM jc JOIN jt ON jc.slice IS NOT DISTINCT FROM jt.slice JOIN jd ON jc.slice IS NOT DISTINCT FROM jd.slice
            JOIN ff ON jc.slice IS NOT DISTINCT FROM ff.slice),
jsc AS (SELECT *, greatest(0.0, least(100.0, 100.0::DOUBLE
      - (CASE WHEN invalid_lines > 0 THEN least(30, invalid_lines * 2) ELSE 0 END)::DOUBLE
      - (CASE WHEN empty_count > 0 THEN least(25.0::DOUBLE, empty_count / valid_lines * 100 * 5.0::DOUBLE) ELSE 0 END)::DOUBLE
      - (CASE WHEN dup_count > 0 THEN least(20.0::DOUBLE, total_duplicates / valid_lines * 100 * 2.0::DOUBLE) ELSE 0 END)::DOUBLE
      - (CASE WHEN valid_lines < 100 THEN 15 WHEN valid_lines < 500 THEN 5 ELSE 0 END)::DOUBLE
      - (CASE WHEN p95_tokens > 4096 THEN 10 ELSE 0 END)::DOUBLE
      - (CASE WHEN avg_tokens < 50 THEN 10 ELSE 0 END)::DOUBLE)) AS score FROM ja)
"""
from .common import d_blank as _db  # noqa: E402
D_JSONL_V = D_JSONL_V.replace("{blank_i}", _db("instruction")).replace("{blank_o}", _db("output")).replace(
    "{blank_t}", _db("text"))


@register("snk_audit_report", sql="WITH " + D_JSONL_V + f""",
ja0 AS (
  SELECT slice,
         CASE WHEN messages IS NOT NULL
              THEN array_to_string(list_transform(messages, lambda m: coalesce(json_extract_string(m, '$.content'), '')), ' ')
              ELSE coalesce(instruction, '') || ' ' || coalesce(output, '') END AS t,
         CASE WHEN messages IS NOT NULL THEN coalesce(json_extract_string(list_filter(messages, lambda m:
                   json_extract_string(m, '$.role') = 'assistant')[-1], '$.content'), '')
              ELSE coalesce(output, '') END AS o
  FROM js WHERE status = 'ok'),
ja1 AS (SELECT slice, length(t) AS chars, {d_tokens_f('t')} AS tf, md5(t) AS k, {d_short('o')} AS short FROM ja0),
ja2 AS (SELECT slice, count(*) AS n, avg(chars) AS mc, list_sort(list(chars)) AS sc, list_sort(list(tf)) AS st,
               count(*) FILTER (WHERE short) AS short_n, count(*) - count(DISTINCT k) AS dup_n FROM ja1 GROUP BY slice)
SELECT jsc.slice, total_lines, valid_lines, invalid_lines, detected_format, empty_count, dup_count, total_duplicates,
       p95_tokens, round_even(score, 1) AS score, round_even(avg_tokens, 1) AS avg_tokens,
       CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair'
            WHEN score >= 40 THEN 'Poor' ELSE 'Unusable' END AS grade, score >= 60 AS passed,
       ja2.n AS a_samples, {d_np_round('ja2.mc', 1)} AS a_mean_chars,
       CAST(trunc({d_np_quantile('ja2.sc', 'ja2.n', 0.95)}) AS BIGINT) AS a_p95_chars,
       CAST(trunc({d_np_quantile('ja2.st', 'ja2.n', 0.95)}) AS BIGINT) AS a_p95_tokens,
       round_even(ja2.short_n / ja2.n, 4) AS a_empty_output_ratio, round_even(ja2.dup_n / ja2.n, 4) AS a_duplicate_ratio,
       ff.first_fmt_a AS a_format
FROM jsc LEFT JOIN ja2 ON jsc.slice IS NOT DISTINCT FROM ja2.slice LEFT JOIN ff ON jsc.slice IS NOT DISTINCT FROM ff.slice""")
def snk_audit_report(spark, sf):
    """Analyzer + validator report of the JSON-lines fixture, one JSON document per slice
    (length, quality, format, passed, stats with floats to 1 decimal, issues, advice), read back."""
    rep = au.audit_report(_jsonl(spark, sf), ["slice"], ORDER)
    path = scratch_path(spark, "report")
    sinks.write_report(rep, path)
    back = sinks.read_report(spark, path)
    return back.select("slice", "stats.total_lines", "stats.valid_lines", "stats.invalid_lines",
                       "stats.detected_format", "stats.empty_count", "stats.dup_count", "stats.total_duplicates",
                       "stats.p95_tokens", "stats.score", "stats.avg_tokens", "stats.grade", "passed",
                       F.col("length.total_samples").alias("a_samples"), F.col("length.mean").alias("a_mean_chars"),
                       F.col("length.percentile_95").alias("a_p95_chars"),
                       F.col("length.estimated_p95_tokens").alias("a_p95_tokens"),
                       F.col("quality.empty_output_ratio").alias("a_empty_output_ratio"),
                       F.col("quality.duplicate_ratio").alias("a_duplicate_ratio"),
                       F.col("format.format").alias("a_format"))


@register("snk_train_text", sql="""
WITH r AS (
  SELECT source AS slice, doc_id,
         row_number() OVER (PARTITION BY source ORDER BY md5('42|' || CAST(doc_id AS VARCHAR))) AS rk,
         count(*) OVER (PARTITION BY source) AS n, text FROM documents)
SELECT CASE WHEN rk <= ceil(0.1::DOUBLE * n) THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows,
       CAST(sum(length(text)) AS BIGINT) AS chars
FROM r GROUP BY 1""")
def snk_train_text(spark, sf):
    """CPT text rows split per source and written partitioned by split; per-split totals read back."""
    d = fx.table(spark, sf, "documents").select(F.col("source").alias("slice"), "doc_id", "text")
    s = prep.split(d, "doc_id", ["slice"])
    path = scratch_path(spark, "train")
    sinks.write_train(s.select("split", "slice", "doc_id", F.col("text")), path)
    back = sinks.read_train(spark, path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("chars"))


@register("snk_eval_results", sql="""
WITH c AS (SELECT item_id, text, '### Instruction:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10) AS p
           FROM benchmark)
SELECT item_id, text AS instruction, p AS formatted_prompt, text AS expected,
       text AS base_model_output, """ + d_strip("text") + """ AS lora_model_output FROM c""")
def snk_eval_results(spark, sf):
    """Side-by-side eval rows written as JSON and read back."""
    rows = _eval_rows(spark, sf)
    path = scratch_path(spark, "eval")
    sinks.write_eval(rows, path)
    return sinks.read_eval(spark, path)


def _eval_rows(spark, sf):
    e = fx.eval_outputs(spark, sf)
    cases = e.select("item_id", "instruction", "expected", "formatted_prompt")
    base = e.select("item_id", "base_raw")
    tuned = e.select("item_id", "tuned_raw")
    return ev.side_by_side(cases, base, tuned, "item_id")


@register("snk_qa_text", sql="""
WITH q AS (SELECT row_number() OVER (ORDER BY item_id) AS q_no, text FROM benchmark)
SELECT q_no, 'Q' || CAST(q_no AS VARCHAR) || ': ' || text || chr(10) || 'A' || CAST(q_no AS VARCHAR) || ': '
       || text || chr(10) || chr(10) AS block
FROM q""")
def snk_qa_text(spark, sf):
    """Q/A text blocks: question i (item order) and its base-model answer."""
    rows = _eval_rows(spark, sf)
    from ..sources.lines import number_rows
    numbered = number_rows(rows, "item_id", out="q_no")
    return ev.qa_blocks(numbered, "q_no", "instruction", "base_model_output")
