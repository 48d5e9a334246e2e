"""Joins (§2.4) other than the plan override join."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.joins import join_on
from ..operators import logs as lg
from ..operators import prep
from ..session import land
from ..sources import fixtures as fx
from .common import d_fp, d_key, d_strip, register
from .q_logs import D_LOG, D_SIGS


@register("jn_eval_side_by_side", sql=f"""
WITH c AS (SELECT item_id, text, '### Instruction:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10) AS p
           FROM benchmark)
SELECT item_id, text AS instruction, p AS formatted_prompt, text AS expected,
       text AS base_model_output, {d_strip('text')} AS lora_model_output FROM c""")
def jn_eval_side_by_side(spark, sf):
    """Test case ⋈ base output ⋈ tuned output on the case id."""
    from .q_sources import _eval_rows
    return _eval_rows(spark, sf)


@register("jn_holdout_anti", sql=f"""
WITH r AS (SELECT doc_id, source, text,
                  row_number() OVER (PARTITION BY source ORDER BY md5('42|' || CAST(doc_id AS VARCHAR))) AS rk,
                  count(*) OVER (PARTITION BY source) AS n FROM documents),
h AS (SELECT DISTINCT {d_key('text')} AS k FROM r WHERE rk <= ceil(0.1::DOUBLE * n))
SELECT doc_id, source FROM documents WHERE {d_key('text')} NOT IN (SELECT k FROM h)""")
def jn_holdout_anti(spark, sf):
    """Documents whose whole normalised text is absent from the held-out test split (left anti join):
    keeps eval cases and their copies out of training."""
    d = fx.table(spark, sf, "documents").select("doc_id", "source", "text")
    h = fx.holdout(spark, sf).select("text")
    return prep.exclude_holdout(d, h).select("doc_id", "source")


@register("jn_dup_members", sql=f"""
WITH g AS (SELECT source AS slice, doc_id, {d_fp('text')} AS fp FROM documents),
c AS (SELECT slice, fp, count(*) AS group_size FROM g GROUP BY 1, 2 HAVING count(*) > 1)
SELECT g.slice, g.doc_id, c.group_size, md5(g.fp) AS group_key FROM g JOIN c ON g.slice IS NOT DISTINCT FROM c.slice AND g.fp = c.fp""")
def jn_dup_members(spark, sf):
    """Near-duplicate groups joined back to their member rows."""
    d = fx.table(spark, sf, "documents").select(F.col("source").alias("slice"), "doc_id",
                                                tx.fingerprint("text").alias("fp"))
    d = land(d, "fingerprints")  # narrow rows; the fingerprint pass runs once for both sides
    groups = d.groupBy("slice", "fp").agg(F.count(F.lit(1)).alias("group_size")).filter(F.col("group_size") > 1)
    return join_on(d, groups, ["slice", "fp"]).select("slice", "doc_id", "group_size", F.md5("fp").alias("group_key"))


@register("jn_log_signatures", sql="WITH " + D_LOG + ", " + D_SIGS + """
SELECT lg.event_id, lg.run_id, s.signature, s.cause FROM lg, sigs s
WHERE lg.line IS NOT NULL AND position(lower(s.signature) IN lower(lg.line)) > 0""")
def jn_log_signatures(spark, sf):
    """Log lines × known error signatures (case-insensitive substring), with cause."""
    m = lg.match_signatures(fx.log_lines(spark, sf))
    return m.select("event_id", "run_id", "signature", "cause")
