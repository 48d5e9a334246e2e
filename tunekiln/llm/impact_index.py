"""Exact top-k search by inner product over an impact-ordered, score-at-a-time index.

Components are quantised to floor(STEP * x) integers. Equal vectors form one class, which keeps its KEEP least ids
(no query needs more of them); classes are dealt by hash into shards of about SHARD vectors. The index is a written
table with a row for each posting segment of a shard: all postings of one impact (the component's size, in at
most LEVELS steps), as lists by component and sign. Another row holds the shard's vectors and ids.

Query vectors meet shards in cells of a grid, (block of queries) x (lane of shards), each bounded. A cell takes its
shards one after the other and a shard's segments by descending impact: a list adds its impact times the
queries' weights to the scores of its vectors. What a vector has not yet added is at most the norm of its rest
times the norm of the query (Cauchy-Schwarz), so a vector can only be a member if its score so far and that bound
together reach the query's KEEP-th best exact score so far. Segments are left out only on that proof, once few
possible members remain; those are scored exactly. Results are exact: recall is 1 by proof, and tested.

Equal query vectors are searched once; each query then leaves out its own row.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without an id, take no part;
shorter vectors count as followed by zeros (an empty one is all zeros); equal rows are one; rows that share an id
with different vectors are queries and candidates each; ties go to the smaller id; scores are 64-bit integers, and
components beyond 2**62 count as that; an empty table, or one without queries, gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import land

STEP = 64
TOP, KEEP = 20, 21     # KEEP: one more, as a query leaves out its own row
SHARD = 4096           # distinct vectors of a shard, about
LANE = 64              # shards of a cell at most
BLOCK = 16_384         # query vectors of a cell, about
LOT = 512              # query vectors scored at a time
LEVELS = 255           # steps of impact
CHECKS = (0.4, 0.55, 0.7, 0.8, 0.9)  # shares of a shard's postings after which the proof is tried
FEW = 0.02             # share of (vector, query) pairs that are scored exactly rather than by further segments
HOT = 10_000           # query rows of one vector in one task at most
INDEX = "shard int, impact bigint, n int, width int, lists binary, ids binary, members array<array<bigint>>"


def pack(q: np.ndarray) -> bytes:
    """A vector of integers as bytes; equal vectors have equal bytes, zeros at the end do not count."""
    q = np.trim_zeros(q, "b")
    small = len(q) == 0 or np.abs(q).max() < 1 << 15
    return (b"\x02" + q.astype("<i2").tobytes()) if small else b"\x08" + q.astype("<i8").tobytes()


def matrix(packed: list[bytes], dims: int = 0) -> np.ndarray:
    rows = [np.frombuffer(p, dtype="<i2" if p[0] == 2 else "<i8", offset=1) for p in packed]
    dims = max([dims, *map(len, rows)])
    out = np.zeros((len(rows), dims), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, vec): the distinct rows that take part, their vectors quantised and packed."""
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def quantise(batches):
        for b in batches:
            column = b.column("embedding")
            ids, out = [], []
            for i, x in zip(b.column("vec_id").to_pylist(), column):
                x = x.values if x.is_valid else None
                if x is None or x.null_count:
                    continue
                x = x.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all():
                    ids.append(i)
                    out.append(pack(np.clip(np.floor(STEP * x), -2.0 ** 62, 2.0 ** 62).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return rows.filter("vec_id is not null").mapInArrow(quantise, "vec_id bigint, vec binary").distinct()


def _segments(v: np.ndarray):
    """(impact, lists, ids) of a shard by descending impact; ``lists`` holds (2 * component + sign, length) pairs."""
    step = max(1, -(-int(np.abs(v).max(initial=0)) // LEVELS))
    level = np.abs(v) // step
    d, i = np.nonzero(level.T)
    key = 2 * d + (v[i, d] < 0)
    order = np.lexsort((i, key, -level[i, d]))
    at, key, i = level[i, d][order], key[order], i[order]
    edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        keys, lengths = np.unique(key[a:b], return_counts=True)
        yield int(at[a]) * step, np.stack([keys, lengths], axis=1).astype("<u4").tobytes(), i[a:b].astype("<u4").tobytes()


def build(classes: DataFrame) -> DataFrame:
    """The written index of (vec, ids, shard) rows."""
    def shard(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec")
        v = matrix(t.column("vec").to_pylist())
        n, k = v.shape
        made = [(None, v.astype("<i8").tobytes(), None)] + list(_segments(v))
        members = [t.column("ids").to_pylist()] + [None] * (len(made) - 1)
        cols = [[t.column("shard")[0].as_py()] * len(made), [m[0] for m in made], [n] * len(made), [k] * len(made), [m[1] for m in made], [m[2] for m in made], members]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
        return pa.table([pa.array(c, x) for c, x in zip(cols, types)], names=["shard", "impact", "n", "width", "lists", "ids", "members"])

    return land(classes.groupBy("shard").applyInArrow(shard, INDEX), "impact-index")


class _Best:
    """The best KEEP rows of each query of a cell so far, and the scores that a further row must reach."""

    def __init__(self, queries: int):
        self.rows = [np.zeros(0, dtype=np.int64) for _ in range(4)]  # query, score, id, whether the vectors are equal
        self.least = np.full(queries, -(1 << 63), dtype=np.int64)

    def add(self, q, score, ids, same):
        q, score, ids, same = (np.concatenate([a, np.asarray(b, dtype=np.int64)]) for a, b in zip(self.rows, (q, score, ids, same)))
        order = np.lexsort((ids, -score, q))
        q, score, ids, same = q[order], score[order], ids[order], same[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < KEEP
        self.rows = [q[keep], score[keep], ids[keep], same[keep]]
        full = rank == KEEP - 1
        self.least[q[full]] = score[full]


def _exact(v: np.ndarray, w: np.ndarray, i: np.ndarray, q: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), dtype=np.int64)
    for a in range(0, len(i), 1 << 14):
        out[a:a + (1 << 14)] = np.einsum("ij,ij->i", v[i[a:a + (1 << 14)]], w[q[a:a + (1 << 14)]])
    return out


def _search(v: np.ndarray, segments: list, w: np.ndarray, least: np.ndarray):
    """(vector, query, score) of all pairs that may stand among a query's KEEP best."""
    norms = np.sqrt((v.astype(float) ** 2).sum(1)), np.sqrt((w.astype(float) ** 2).sum(1))
    most = norms[0].max(initial=0) * norms[1].max(initial=0)
    kind = np.int16 if most < 32_000 else np.int32 if most < 2e9 else np.int64
    score = np.zeros((len(v), len(w)), dtype=kind)
    weights = np.ascontiguousarray(w.T.astype(kind))
    size = np.abs(v)
    rest = (v.astype(float) ** 2).sum(1)
    least, total, done, tries = least.copy(), sum(len(s[2]) for s in segments), 0, list(CHECKS)

    def possible():
        # a vector's score can still grow by the bound at most; the margin covers the rounding
        bound = np.outer(np.sqrt(np.maximum(rest, 0)) * (1 + 1e-6), norms[1]) + (1 + most * 1e-9)
        return score >= least.astype(float)[None, :] - bound

    for impact, lists, ids in segments:
        at = 0
        for key, length in lists.tolist():
            own, d = ids[at:at + length], key >> 1
            at += length
            score[own] += weights[d] * kind(-impact if key & 1 else impact)
            x = size[own, d].astype(float)
            rest[own] -= x ** 2 - (x - impact) ** 2
        done += len(ids)
        if tries and done >= tries[0] * total:
            tries = [t for t in tries if done < t * total]
            if (least == -(1 << 63)).any() and len(v) >= KEEP:
                # the exact scores of the vectors in front give a score that members must reach
                front = np.argpartition(-score.astype(np.int64), KEEP - 1, axis=0)[:KEEP]
                q = np.broadcast_to(np.arange(len(w)), front.shape)
                reached = _exact(v, w, front.ravel(), q.ravel()).reshape(front.shape).min(axis=0)
                least = np.maximum(least, reached)
            ok = possible()
            if ok.sum() <= FEW * ok.size:
                break
    else:
        ok = possible()
    i, q = np.nonzero(ok)
    exact = _exact(v, w, i, q)
    good = exact >= least[q]
    return i[good], q[good], exact[good]


def _cell(queries: pa.Table, index: pa.Table) -> pa.Table:
    w = matrix(queries.column("vec").to_pylist())
    best = _Best(len(w))
    shards: dict[int, list[int]] = {}
    for row, s in enumerate(index.column("shard").to_pylist()):
        shards.setdefault(s, []).append(row)
    impacts = index.column("impact").to_pylist()
    for rows in shards.values():
        rows.sort(key=lambda r: (impacts[r] is not None, -(impacts[r] or 0)))
        get = lambda c, r: index.column(c)[r].as_py()
        n, k = get("n", rows[0]), get("width", rows[0])
        v = np.frombuffer(get("lists", rows[0]), dtype="<i8").reshape(n, k)
        members = get("members", rows[0])
        segments = [(impacts[r], np.frombuffer(get("lists", r), dtype="<u4").reshape(-1, 2), np.frombuffer(get("ids", r), dtype="<u4").astype(np.int64)) for r in rows[1:]]
        width = max(k, w.shape[1])
        v = np.pad(v, ((0, 0), (0, width - k)))
        ww = np.pad(w, ((0, 0), (0, width - w.shape[1])))
        counts = np.array([len(m) for m in members])
        flat = np.array([x for m in members for x in m], dtype=np.int64)
        begin = np.cumsum(counts) - counts
        found = []
        for a in range(0, len(ww), LOT):
            i, q, score = _search(v, segments, ww[a:a + LOT], best.least[a:a + LOT])
            found.append((i, q + a, score))
        i, q, score = (np.concatenate(x) for x in zip(*found))
        same = (v[i] == ww[q]).all(axis=1) if len(i) else np.zeros(0, dtype=bool)
        each = counts[i]  # a class stands for its rows
        place = np.repeat(begin[i], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        best.add(np.repeat(q, each), np.repeat(score, each), flat[place], np.repeat(same, each))
    q, score, ids, same = best.rows
    return pa.table({"q": queries.column("q").to_numpy()[q], "score": score, "vec_id": ids, "same": same.astype(bool)})


def _grid(queries: int, shards: int, cores: int) -> tuple[int, int]:
    """Blocks of queries and lanes of shards."""
    return max(1, math.ceil(queries / BLOCK)), max(math.ceil(shards / LANE), min(shards, 2 * cores), 1)


def search(table: DataFrame, is_query: Column) -> DataFrame:
    """(query_id, rank, vec_id, score): the TOP best rows for each row where ``is_query`` holds, its own left out."""
    rows = land(vectors(table), "impact-vectors")
    least = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    kept = rows.withColumn("_r", least).filter(F.col("_r") <= KEEP)
    classes = land(kept.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "impact-classes")
    shards = max(1, math.ceil(classes.count() / SHARD))
    index = build(classes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int")))
    asked = rows.filter(is_query)
    queries = asked.groupBy("vec").agg(F.count(F.lit(1)).alias("m")).withColumn("q", F.monotonically_increasing_id())
    queries = land(queries, "impact-queries")
    blocks, lanes = _grid(queries.count(), shards, table.sparkSession.sparkContext.defaultParallelism)
    block = lambda: F.pmod(F.xxhash64(F.lit(1), "vec"), F.lit(blocks)).cast("int").alias("block")
    left = queries.select("q", "vec", block(), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    right = index.select("*", (F.col("shard") % lanes).alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    met = left.groupBy("block", "lane").cogroup(right.groupBy("block", "lane")).applyInArrow(_safe_cell, "q bigint, score bigint, vec_id bigint, same boolean")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "same")
    best = land(met.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= KEEP), "impact-best")
    best = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_r", "score", "vec_id", "same"))).alias("rows"))
    # a vector that very many queries share is dealt over several tasks; such vectors are few: queries / HOT at most
    salts = F.when(F.col("m") > HOT, F.ceil(F.col("m") / HOT)).otherwise(1).cast("int")
    hot = queries.filter(F.col("m") > HOT).select("vec", salts.alias("salts"))
    asked = asked.join(F.broadcast(hot), "vec", "left").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    named = queries.join(best, "q").select("vec", "rows", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    j = asked.select("vec", "salt", F.col("vec_id").alias("query_id")).join(named, ["vec", "salt"])
    others = F.slice(F.filter("rows", lambda r: ~(r["same"] & (r["vec_id"] == F.col("query_id")))), 1, TOP)
    out = j.select("query_id", F.posexplode(others).alias("i", "r"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score"))


def _safe_cell(queries: pa.Table, index: pa.Table) -> pa.Table:
    if queries.num_rows == 0 or index.num_rows == 0:
        return pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "same": pa.array([], pa.bool_())})
    return _cell(queries, index)


def query_rows() -> Column:
    return F.col("vec_id") % 20 == 0


ORACLE = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, x -> floor({STEP} * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND (a.vec_id <> b.vec_id OR a.q <> b.q)),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
