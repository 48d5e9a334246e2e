"""Substring joins through q-grams: which texts contain which patterns, for tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import land

GRAM = 4                # characters of a gram; shorter patterns have a gram of their own length
SMALL_ROWS = 1_000_000  # grams (some 50 bytes each) that are broadcast


def _grams(text: Column, size: int) -> Column:
    """The distinct stretches of ``size`` characters."""
    n = F.length(text) - F.lit(size - 1)
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(n > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def substring_join(texts: DataFrame, text: Column, patterns: DataFrame, pattern: Column) -> DataFrame:
    """The rows of ``texts`` with each row of ``patterns`` whose ``pattern`` their ``text`` contains.

    Each pattern is filed under its gram that fewest patterns have (an inverted index); a text's grams
    propose the patterns filed there and ``contains`` verifies them, so texts and patterns are not all compared. A
    text that contains a pattern has that gram, so no pair is lost; as a pattern has one gram and a text's grams are
    distinct, none comes twice. The smaller of the gram tables is broadcast if it is small by count. Null texts and
    null or empty patterns match nothing. The two frames must not share column names."""
    p = patterns.withColumn("_p", pattern).filter(F.length("_p") > 0).withColumn("_id", F.monotonically_increasing_id())
    p = land(p.withColumn("_q", F.least(F.length("_p"), F.lit(GRAM))), "patterns")
    sizes = [r["_q"] for r in p.select("_q").distinct().collect()]  # GRAM values at most
    if not sizes:
        return texts.crossJoin(patterns.limit(0)).limit(0)
    own = F.lit(None).cast("array<string>")
    for q in sizes:
        own = F.when(F.col("_q") == q, _grams(F.col("_p"), q)).otherwise(own)
    each = p.select("_id", F.explode(own).alias("_g"))
    rare = each.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).join(each, "_g")
    filed = rare.groupBy("_id").agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g"))
    index = land(p.join(filed, "_id").drop("_id", "_q"), "pattern-index")
    t = texts.withColumn("_t", text)
    grams = t.filter("_t is not null").withColumn("_g", F.explode(F.flatten(F.array(*[_grams(F.col("_t"), q) for q in sizes]))))
    hit = grams.join(F.broadcast(index) if index.count() <= SMALL_ROWS else index, "_g").filter(F.contains("_t", "_p"))
    return hit.select(*texts.columns, *patterns.columns)
