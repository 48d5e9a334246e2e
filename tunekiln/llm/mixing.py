"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a share of all words by its weight, capped at ``cap`` times its own size. Whole passes
over a source come first; the rest of its budget is filled by documents chosen by exact length: the
histogram of lengths is scaled down in proportion, and a bounded-knapsack dynamic program closes the
remaining gap. Documents of one length are then taken in the order of a seeded hash.

Only (id, source, size, hash) rows and histograms are shuffled. A hot (source, length) group is dealt
over ``BUCKETS`` hash ranges, so no task ranks more than about 1/BUCKETS of it.

Defined cases: null or blank text has size 0 and takes 0; a null source is a source of its own, last in
order; repeated rows count each for itself, and rows that tie in hash and id are interchangeable; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import land, words_of

WEIGHTS = (5, 2, 1)   # by source in code point order, repeating; null last
CAP = 3               # a document is taken at most so many times
SEED = 20240611
BUCKETS = 1024        # hash ranges within a (source, length) group
GAP = 16384           # words that the dynamic program closes at least; larger gaps are first filled by long documents
LONGEST = 4           # it closes so many times the longest document, so that it can trade long ones


def word_sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, _h): number of words of the whole text and the seeded hash of the id."""
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.size(words_of(F.col("text"))).cast("bigint").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_h"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: (source, source_size, target).

    Water filling: sources in ascending order of cap * size / weight reach their cap first; the level is
    the one at which the next source stays below its cap. One row per source is all that is sorted."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", w).withColumn("_top", F.col("source_size") * F.lit(float(cap)))
    rank = Window.orderBy(F.col("_top") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before, after = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("_top").over(before), F.lit(0.0)))
             / F.sum("_w").over(after))
    per = per.withColumn("_level", level)
    # the first source below its cap sets the level for itself and all later ones
    fits = F.col("_level") * F.col("_w") <= F.col("_top")
    final = F.min(F.struct((~fits).alias("no"), (F.col("_top") / F.col("_w")).alias("at"), F.col("_level").alias("level"))).over(everything)
    per = per.withColumn("_l", F.when(~final["no"], final["level"]))
    return per.select("source", "source_size",
                      F.least(F.col("_top"), F.coalesce(F.col("_l") * F.col("_w"), F.col("_top"))).alias("target"))


def fit_counts(sizes: list[int], counts: list[int], budget: int, gap: int = GAP) -> list[int]:
    """How many documents of each size to take so that their words come as near ``budget`` as possible
    from below. ``sizes`` are distinct and positive."""
    total = sum(s * n for s, n in zip(sizes, counts))
    if budget >= total:
        return list(counts)
    gap = max(gap, LONGEST * max(sizes))
    by_size = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    # in proportion up to half a gap below the budget, so that the program has documents to choose from; rounded over
    # the running count, which strays by one document at most and lets lengths that stand once take part
    share, upto, take = max(0, budget - gap // 2), 0, [0] * len(sizes)
    for i in by_size:
        take[i] = (upto + counts[i]) * share // total - upto * share // total
        upto += counts[i]
    rest = budget - sum(s * k for s, k in zip(sizes, take))
    for i in by_size:
        if rest <= gap:
            break
        more = min(counts[i] - take[i], rest // sizes[i])
        take[i] += more
        rest -= more * sizes[i]
    # bounded knapsack over the rest: bit b of ``reach`` says that b words can be reached
    reach, steps, mask = 1, [], (1 << (min(rest, gap) + 1)) - 1
    for i in by_size:
        if reach > mask >> 1:  # the whole rest is reached
            break
        left, lot = min(counts[i] - take[i], min(rest, gap) // sizes[i]), 1
        while left > 0:
            lot = min(lot, left)
            grown = (reach | reach << (lot * sizes[i])) & mask
            if grown != reach:
                steps.append((i, lot, reach))
                reach = grown
            left -= lot
            lot *= 2
    at = reach.bit_length() - 1
    for i, lot, before in reversed(steps):
        if not before >> at & 1:
            take[i] += lot
            at -= lot * sizes[i]
    return take


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    total = int(pdf["source_size"].iloc[0])
    target = float(pdf["target"].iloc[0])
    whole = int(target // total) if total else 0
    pdf = pdf.sort_values("size")
    live = pdf["size"] > 0
    k = pd.Series(0, index=pdf.index, dtype="int64")
    if total:
        k[live] = fit_counts([int(x) for x in pdf["size"][live]], [int(x) for x in pdf["n"][live]],
                             int(round(target - whole * total)))
    return pd.DataFrame({"_key": pdf["_key"], "size": pdf["size"], "_whole": whole, "_k": k})


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): ``copies`` is how often the mix takes
    the document, ``taken`` its words counted as often."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    base = land(word_sizes(docs, seed).withColumn("_b", F.pmod(F.col("_h"), F.lit(BUCKETS)).cast("int")), "mix-sizes")
    goal = land(targets(base, weights, cap).withColumn("_key", key).drop("source"), "mix-targets")
    parts = base.withColumn("_key", key).groupBy("_key", "size", "_b").agg(F.count(F.lit(1)).alias("n"))
    parts = land(parts, "mix-lengths")
    lengths = parts.groupBy("_key", "size").agg(F.sum("n").alias("n")).join(goal, "_key")
    plan = land(lengths.groupBy("_key").applyInPandas(_fit, "_key string, size bigint, _whole bigint, _k bigint"), "mix-plan")
    w = Window.partitionBy("_key", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_off", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n").join(plan, ["_key", "size"])
    rows = base.withColumn("_key", key).join(parts, ["_key", "size", "_b"])
    pick = F.row_number().over(Window.partitionBy("_key", "size", "_b").orderBy("_h", "doc_id"))
    copies = F.col("_whole") + F.when(F.col("_off") + pick <= F.col("_k"), 1).otherwise(0)
    return (rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("bigint"))
            .join(goal, "_key")
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken")))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as the mix takes it.

    The copies are attached by (id, source, size); a repeated row is numbered among its equals so that
    each meets one row of the plan."""
    names = docs.columns
    size = F.size(words_of(docs["text"])).cast("bigint")
    same = Window.partitionBy("_mx_id", "_mx_source", "_mx_size")
    left = docs.select(F.struct(*[docs[c] for c in names]).alias("_mx_row"), docs["doc_id"].alias("_mx_id"),
                       docs["source"].cast("string").alias("_mx_source"), size.alias("_mx_size"))
    left = left.withColumn("_mx_n", F.row_number().over(same.orderBy("_mx_row")))
    plan = mix(docs, weights, cap, seed).select(
        F.col("doc_id").alias("_mx_id"), F.col("source").alias("_mx_source"), F.col("size").alias("_mx_size"), "copies")
    plan = plan.withColumn("_mx_n", F.row_number().over(same.orderBy(F.col("copies").desc()))).filter("copies > 0")
    on = ["_mx_id", "_mx_source", "_mx_size", "_mx_n"]
    p = plan.select(*[F.col(c).alias(c + "_p") for c in on], "copies")
    cond = [F.col(c).eqNullSafe(F.col(c + "_p")) for c in on]
    return (left.join(p, cond).select("_mx_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_mx_copy"))
            .select("_mx_row.*"))
