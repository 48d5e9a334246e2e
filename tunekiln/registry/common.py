"""Registration helpers and DuckDB spellings of the text rules (for the oracle SQL only)."""

from __future__ import annotations

from typing import Callable

from ..functions import text as tx

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            from ..session import prepare
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return run
    return deco


# ---- DuckDB spellings (RE2 accepts the same \x{...} classes) ---------------

def d_cjk(t: str, cls: str = tx.CJK_CLASS) -> str:
    return f"(length({t}) - length(regexp_replace({t}, '{cls}', '', 'g')))"


def d_tokens_f(t: str, cls: str = tx.CJK_CLASS) -> str:
    c = d_cjk(t, cls)
    return f"({c} * 2.0::DOUBLE + (length({t}) - {c}) * 0.3::DOUBLE)"


def d_tokens_v(t: str) -> str:
    return f"CAST(trunc({d_tokens_f(t)}) AS BIGINT)"


def d_tokens_t(t: str) -> str:
    return f"CAST(trunc({d_tokens_f(t, tx.CJK_CLASS_T)}) AS BIGINT)"


def d_strip(t: str) -> str:
    ws = tx.WS_CLASS
    return f"regexp_replace({t}, '\\A{ws}+|{ws}+\\z', '', 'g')"


def d_blank(t: str) -> str:
    return f"coalesce({d_strip(t)} = '', true)"


def d_fp(t: str) -> str:
    return f"substring(regexp_replace(lower(coalesce({t}, '')), '{tx.WS_CLASS}', '', 'g'), 1, 200)"


def d_key(t: str) -> str:
    """Digest of the whole normalised text."""
    return f"md5(regexp_replace(lower(coalesce({t}, '')), '{tx.WS_CLASS}', '', 'g'))"


def d_short(t: str) -> str:
    return f"(length({d_strip('coalesce(' + t + ', \'\')')}) < 5)"


# nearest rank over a sorted list column ``s`` of length ``n`` (DuckDB lists are 1-based)
def d_rank(s: str, n: str, p: float | None) -> str:
    if p is None:
        return f"{s}[({n} // 2) + 1]"
    return f"{s}[least(CAST(floor({n} * {p}::DOUBLE) AS BIGINT), {n} - 1) + 1]"


def d_np_quantile(s: str, n: str, q: float) -> str:
    """numpy linear percentile over a sorted list ``s`` of length ``n`` (1-based lists)."""
    vi = f"(({n} - 1)::DOUBLE * {q}::DOUBLE)"
    a = f"{s}[CAST(floor({vi}) AS BIGINT) + 1]::DOUBLE"
    b = f"{s}[least(CAST(floor({vi}) AS BIGINT) + 1, {n} - 1) + 1]::DOUBLE"
    g = f"({vi} - floor({vi}))"
    return (f"(CASE WHEN {vi} >= {n} - 1 THEN {s}[{n}]::DOUBLE WHEN {g} >= 0.5 THEN {b} - ({b} - {a}) * (1.0 - {g}) "
            f"ELSE {a} + ({b} - {a}) * {g} END)")


def d_np_median(s: str, n: str) -> str:
    return f"(({s}[({n} - 1) // 2 + 1]::DOUBLE + {s}[{n} // 2 + 1]::DOUBLE) / 2.0)"


def d_np_round(x: str, d: int) -> str:
    f = float(10 ** d)
    return f"(round_even(({x}) * {f}, 0) / {f})"


# Fixture spellings shared by several oracle queries.
D_PAIRS = """
pairs AS (
  SELECT conv_id, turn, prev_text AS instruction, text AS output FROM (
    SELECT conv_id, turn, role, text,
           lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role,
           lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_text
    FROM conversations) WHERE role = 'assistant' AND prev_role = 'user')
"""

# documents as JSON lines with defects, numbered per slice (blank lines stay in line_no).
D_JSONL = """
jl0 AS (
  SELECT source AS slice, doc_id AS sample_id,
         CASE doc_id % 3 WHEN 0 THEN CAST(to_json({'text': text}) AS VARCHAR)
              WHEN 1 THEN CAST(to_json({'instruction': lang, 'output': text}) AS VARCHAR)
              ELSE CAST(to_json({'messages': [{'role': 'user', 'content': source},
                                              {'role': 'assistant', 'content': text}]}) AS VARCHAR) END AS good
  FROM documents),
jl1 AS (
  SELECT slice, sample_id,
         CASE WHEN sample_id % 11 = 0 THEN left(good, length(good) - 1)
              WHEN sample_id % 13 = 0 THEN good || ' x'
              WHEN sample_id % 17 = 0 THEN ''
              WHEN sample_id % 19 = 0 THEN '[1]' ELSE good END AS raw,
         row_number() OVER (PARTITION BY slice ORDER BY sample_id) AS line_no
  FROM jl0),
jl AS (
  SELECT slice, sample_id, raw, line_no,
         row_number() OVER (PARTITION BY slice ORDER BY sample_id) AS nb_no,
         CASE WHEN NOT json_valid(raw) THEN 'bad_json'
              WHEN json_type(raw) = 'OBJECT' THEN 'ok' ELSE 'not_object' END AS status
  FROM jl1 WHERE raw <> ''),
jo AS (
  SELECT *, CASE WHEN status = 'ok' THEN raw END AS obj FROM jl),
js AS (
  SELECT slice, sample_id, line_no, nb_no, status, raw,
         json_exists(obj, '$.messages') AS k_messages,
         json_exists(obj, '$.instruction') AS k_instruction,
         json_exists(obj, '$.output') AS k_output,
         json_exists(obj, '$.conversations') AS k_conversations,
         json_exists(obj, '$.text') AS k_text,
         json_extract_string(obj, '$.instruction') AS instruction,
         json_extract_string(obj, '$.output') AS output,
         json_extract_string(obj, '$.text') AS text,
         CASE WHEN json_type(obj, '$.messages') = 'ARRAY' THEN json_extract(obj, '$.messages[*]') END AS messages
  FROM jo)
"""
