"""JSON lines → canonical sample rows.

Canonical sample columns (all operators read these):

    slice, sample_id, line_no, status                      -- status: ok | bad_json | not_object
    k_messages, k_instruction, k_output, k_conversations, k_text, k_input   -- key present
    instruction, input, output, text                       -- STRING or null
    messages, conversations                                -- ARRAY<TURN> when the value is a list
    fields                                                 -- MAP<STRING,STRING>: text of the other top-level values
    kinds                                                  -- MAP<STRING,STRING>: their kinds (KINDS)

``fields`` and ``kinds`` also hold a format key whose value is not of its usual type (a string in ``messages``, a
list in ``output``). The text of a string is itself, that of a list its items' texts joined with nothing (content,
else value, of objects), that of any other value empty.

TURN = STRUCT<role, content, from, value, is_obj, as_str>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip

TURN_TYPE = "struct<role:string,content:string,from:string,value:string,is_obj:boolean,as_str:string>"
TURN_ARRAY = "array<" + TURN_TYPE + ">"

KINDS = ("string", "list", "empty list", "null", "other")
FORMAT_KEYS = ("messages", "instruction", "output", "conversations", "text", "input")


def strict_json_ok(raw: Column) -> Column:
    """True when ``raw`` is one complete JSON document (rejects trailing text, single quotes).

    ``try_parse_json`` alone accepts trailing text after a document; wrapping the line in an
    array and in an object makes any trailing text a syntax error in one of the two.
    """
    wrapped_arr = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    wrapped_obj = F.try_parse_json(F.concat(F.lit('{"r":'), raw, F.lit("}")))
    return F.coalesce(F.variant_get(wrapped_arr, "$[0]", "variant").isNotNull() & wrapped_obj.isNotNull(),
                      F.lit(False))


# literals that the usual parsers take beside strict JSON, where a value may stand
_BARE = r"(?<=[:\[,][ \t]{0,8})(?:-?Infinity|NaN)(?=[ \t]*[,\]}])"
_ALONE = r"^(?:-?Infinity|NaN)$"


def plain_numbers(raw: Column) -> Column:
    """``NaN`` and ``Infinity`` values of a JSON text as a plain number."""
    return F.regexp_replace(raw, _BARE, "0")


def parse_lines(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``rec`` (VARIANT) and ``status`` to a frame of JSON lines (A strips the line first).

    Two parses per line: the array-wrapped parse both checks the line and yields the record
    (its first element); the object-wrapped parse catches a stray ``]`` that would end the
    array early. A line that fails is tried again with bare ``NaN`` and ``Infinity`` as numbers."""
    strict = py_strip(F.col(raw))
    body = F.when(strict_json_ok(strict), strict).when(strict.rlike(_ALONE), F.lit("0")).otherwise(plain_numbers(strict))
    df = df.withColumn("_body", body)
    body = F.col("_body")
    ok = strict_json_ok(body)
    rec = F.when(ok, F.variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$[0]", "variant"))
    status = (
        F.when(~ok, F.lit("bad_json"))
        .when(body.startswith("{"), F.lit("ok"))
        .otherwise(F.lit("not_object"))
    )
    return df.withColumn("rec", rec).withColumn("status", status).drop("_body")


def _turns_from_variant(v: Column) -> Column:
    arr = F.try_variant_get(v, "$", "array<variant>")
    return F.transform(
        arr,
        lambda x: F.struct(
            F.try_variant_get(x, "$.role", "string").alias("role"),
            F.try_variant_get(x, "$.content", "string").alias("content"),
            F.try_variant_get(x, "$.from", "string").alias("from"),
            F.try_variant_get(x, "$.value", "string").alias("value"),
            F.schema_of_variant(x).startswith("OBJECT").alias("is_obj"),
            F.try_variant_get(x, "$", "string").alias("as_str"),
        ),
    )


def _kind(v: Column) -> Column:
    """Kind of a variant value."""
    t = F.schema_of_variant(v)
    n = F.size(F.try_variant_get(v, "$", "array<variant>"))
    return (F.when(t == "STRING", F.lit("string")).when(t == "VOID", F.lit("null"))
            .when(t.startswith("ARRAY"), F.when(n == 0, F.lit("empty list")).otherwise(F.lit("list"))).otherwise(F.lit("other")))


def _text(v: Column) -> Column:
    """Text of a variant value: a string, or the joined texts of a list's items; else empty."""
    items = _turns_from_variant(v)
    listed = F.array_join(F.transform(items, lambda m: F.when(
        m["is_obj"], F.coalesce(m["content"], m["value"], F.lit(""))).otherwise(F.coalesce(m["as_str"], F.lit("")))), "")
    t = F.schema_of_variant(v)
    return (F.when(t == "STRING", F.try_variant_get(v, "$", "string")).when(t.startswith("ARRAY"), F.coalesce(listed, F.lit("")))
            .otherwise(F.lit("")))


def _present(rec: Column, key: str) -> Column:
    return F.coalesce(F.variant_get(rec, "$." + key, "variant").isNotNull(), F.lit(False))


def to_samples(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Canonical sample columns from ``parse_lines`` output; missing keys give null."""
    rec = F.col("rec")
    cols = [F.col(c) for c in (keep or []) if c in parsed.columns]
    cols += [F.col("status")]
    for k in FORMAT_KEYS:
        cols.append(_present(rec, k).alias("k_" + k))
    for k in ("instruction", "input", "output", "text"):
        cols.append(F.try_variant_get(rec, "$." + k, "string").alias(k))
    for k in ("messages", "conversations"):
        cols.append(_turns_from_variant(F.variant_get(rec, "$." + k, "variant")).alias(k))
    # only values without a typed column, so long texts are not stored twice
    lists = F.array(F.lit("messages"), F.lit("conversations"))
    texts = F.array(*[F.lit(k) for k in FORMAT_KEYS if k not in ("messages", "conversations")])

    def usual(k, v):
        kind = _kind(v)
        return ((F.array_contains(texts, k) & kind.isin("string", "null"))
                | (F.array_contains(lists, k) & kind.isin("list", "empty list", "null")))

    extra = F.map_filter(F.try_variant_get(rec, "$", "map<string,variant>"), lambda k, v: ~usual(k, v))
    cols.append(F.transform_values(extra, lambda k, v: _text(v)).alias("fields"))
    cols.append(F.transform_values(extra, lambda k, v: _kind(v)).alias("kinds"))
    return parsed.select(*cols)


def samples_from_columns(df: DataFrame, instruction=None, input=None, output=None, text=None,
                         messages=None, conversations=None, keep: list[str] | None = None) -> DataFrame:
    """Canonical sample rows from typed columns (Parquet/table inputs; no JSON round trip)."""
    def col_or_null(c, t="string"):
        if c is None:
            return F.lit(None).cast(t)
        return F.col(c) if isinstance(c, str) else c

    parts = {
        "instruction": col_or_null(instruction),
        "input": col_or_null(input),
        "output": col_or_null(output),
        "text": col_or_null(text),
        "messages": col_or_null(messages, TURN_ARRAY),
        "conversations": col_or_null(conversations, TURN_ARRAY),
    }
    given = {k: v is not None for k, v in
             dict(instruction=instruction, input=input, output=output, text=text,
                  messages=messages, conversations=conversations).items()}
    cols = [F.col(c) for c in (keep or [])]
    cols.append(F.lit("ok").alias("status"))
    for k in FORMAT_KEYS:
        cols.append(F.lit(given[k]).alias("k_" + k))
    for k in ("instruction", "input", "output", "text", "messages", "conversations"):
        cols.append(parts[k].alias(k))
    cols += [F.create_map().cast("map<string,string>").alias(c) for c in ("fields", "kinds")]
    return df.select(*cols)


def message_turn(role: Column, content: Column) -> Column:
    """TURN of a ``messages`` list: ``{role, content}``."""
    nul = F.lit(None).cast("string")
    return F.struct(role.alias("role"), content.alias("content"), nul.alias("from"), nul.alias("value"),
                    F.lit(True).alias("is_obj"), nul.alias("as_str"))


def conversation_turn(from_: Column, value: Column) -> Column:
    """TURN of a ``conversations`` list: ``{from, value}``."""
    nul = F.lit(None).cast("string")
    return F.struct(nul.alias("role"), nul.alias("content"), from_.alias("from"), value.alias("value"),
                    F.lit(True).alias("is_obj"), nul.alias("as_str"))


# Alias pairs accepted for instruction/output records (fixed values, in the documented order).
ALIAS_PAIRS = [("prompt", "completion"), ("question", "answer"), ("input", "target"), ("text", "summary")]


def map_aliases(parsed: DataFrame, pairs=ALIAS_PAIRS, keep: list[str] | None = None) -> DataFrame:
    """instruction/output from the first alias pair present; ``instruction``/``output`` win."""
    rec = F.col("rec")
    ins = [F.try_variant_get(rec, "$.instruction", "string")] + [
        F.try_variant_get(rec, "$." + a, "string") for a, _ in pairs]
    outs = [F.try_variant_get(rec, "$.output", "string")] + [
        F.try_variant_get(rec, "$." + b, "string") for _, b in pairs]
    cols = [F.col(c) for c in (keep or [])]
    return parsed.select(*cols, F.coalesce(*ins).alias("instruction"), F.coalesce(*outs).alias("output"))
