"""N-gram Jaccard join with parity sketches.

A text's set is its distinct shingles of ``SHINGLE`` words (a shorter text is one shingle). Each shingle
flips one bit of a sketch, so the Hamming distance of two sketches never exceeds the sets' symmetric
difference, which for two linked sets of a and b shingles is at most (a + b) / 19 at a similarity of 0.9. Sets are
laid out in size bands; in a layout for a difference of at most D shingles are dealt to SPARE * (D + 1) blocks, and
a block's key is the XOR of the hashes in it, a parity sketch of 64 bits each. A difference touches one block, so a
set with more than D blocks that are not empty shares one of them with each linked set (pigeonhole), and empty
blocks, which would bring together sets that have nothing in common, need not be joined on. Only a set with fewer
(it is on the fall-back) joins on its empty blocks too, and so meets the others of that kind. A set joins on its
blocks in its own band's layout, and in the next band's where a partner may lie there.

1. Texts with equal sets form classes; one document stands for each class.
2. Blocks shared by two or more classes form buckets. In a bucket every class is first compared with one
   centre (its least class by a seeded order): sketch distance, then the exact sets. Links merge components.
3. Buckets whose classes are all in one component are finished, the rest get another centre, STAR_ROUNDS
   times. What then remains is compared in full by sketch distance, only between components, and the survivors
   are verified exactly: buckets of up to PAIRS classes by a self-join, larger ones in tiles of at most
   TILE x TILE classes.

No pair that the pigeonhole proposes is left out unless both ends are already connected, so components are
exact, while a large group of near copies costs one comparison for each member and centre. ``links`` gives all linked
pairs of classes instead, with the classes' members. Hot buckets are pre-aggregated and meet their centre by a
broadcast (they are few by count), never gathered. Shingles are 64-bit hashes; sets are compared as such.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; a null id takes part in
its class, whose id is the least id that is not null; rows that share an id count as one document; repeated
rows form a class; an empty table gives an empty result; other columns are ignored, or passed through by
``keep_one``, to which each row is a document by its text, whatever its id (equal rows are one, if they have an id
or a text).
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_shuffles, land, light_batches, per_text
from .components import components

SHINGLE = 3
PERCENT = 90
BAND_STEPS = 3       # a band spans this many factors of 10/9 in size
STAR_ROUNDS = 2
TILE = 1000
PAIRS = 30           # buckets of at most so many classes are compared by a self-join
SPARE = 1.15         # blocks for each one that the pigeonhole needs
HOT_SHARE = 100_000  # a bucket is hot if it holds more than this part of all rows, so at most so many are
HOT_ROWS = 1_000     # and more than so many rows
SAMPLE, HOT = 64, 20 # a key of a thousand classes or more is very likely to stand so often in the sample
SMALL_ROWS = 1_000_000  # key tables of at most so many rows are broadcast, larger ones are shuffled
MEMO = 50_000        # remembered words of a task
LOT = 1 << 20        # bytes of text or of sets that a task turns into Python's values at once
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= MEMO:
            self.clear()
        self[word] = h
        return h


_HASH = _WordHash()


def _rest() -> None:
    """Give memory back at the end of a task: the worker goes on with other work, beside the next stage's joins."""
    _HASH.clear()
    pa.default_memory_pool().release_unused()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ h >> np.uint64(33)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter((_HASH[w] for w in words), dtype=np.uint64, count=len(words))
    k = min(size, len(words))
    n = len(words) - k + 1
    s = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        s = _mix(s * _K[0] + h[i:i + n] * _K[1] + _K[2])
    return np.unique(s)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _bounds(percent: int, upto: int) -> list[int]:
    """Least size of each band. A set's larger partners lie in its own band or in the next one."""
    out = [1]
    while out[-1] <= upto:
        b = out[-1]
        for _ in range(BAND_STEPS):
            b = max(b + 1, 100 * (b - 1) // percent + 1)
        out.append(b)
    return out


def most_different(a: int, b: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference of linked sets of a and b shingles."""
    return (a + b) * (100 - percent) // (100 + percent)


def sketch(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Parity bits of the shingles, as ``blocks`` signed 64-bit words."""
    at = (hashes >> np.uint64(6)) % np.uint64(blocks) * np.uint64(64) + (hashes & np.uint64(63))
    bits = (np.bincount(at.astype(np.int64), minlength=64 * blocks) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<i8")


def wide_sketch(hashes: np.ndarray, blocks: int, most: int) -> list[int | None]:
    """XOR of the hashes in each of ``blocks`` blocks, to join on.

    An empty block is None unless the set has no more than ``most`` others, its greatest difference from a partner."""
    at = (hashes >> np.uint64(6)) % np.uint64(blocks)
    order = np.argsort(at, kind="stable")
    at = at[order].astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    if len(first) <= most:
        out = np.zeros(blocks, dtype=np.uint64)
        out[at[first]] = np.bitwise_xor.reduceat(hashes[order], first)
        return out.view(np.int64).tolist()
    out = [None] * blocks
    for i, v in zip(at[first].tolist(), np.bitwise_xor.reduceat(hashes[order], first).view(np.int64).tolist()):
        out[i] = v
    return out


def describe(text: str | None, percent: int = PERCENT, size: int = SHINGLE) -> dict:
    """Size, signature, band and sketches (own layout, and the next band's where needed) of a text's set.

    ``own`` and ``up`` are the blocks to join on, ``own_bits`` and ``up_bits`` sketches of single bits, whose
    distance bounds the difference."""
    s = shingle_set(text, size)
    n = len(s)
    if n == 0:
        return dict.fromkeys(SETS_COLUMNS) | {"n": 0, "s1": 0, "s2": 0, "band": -1}
    bounds = _bounds(percent, 100 * n // percent + 1)
    band = int(np.searchsorted(bounds, n, side="right")) - 1
    bounds = bounds if band + 2 < len(bounds) else _bounds(percent, bounds[-1])
    blocks = lambda k: ceil(SPARE * (most_different(bounds[k + 1] - 1, bounds[k + 1] - 1, percent) + 1))
    short = lambda k: 1 + (2 * bounds[k + 1]) // 64  # noqa: E731  about two bits for each shingle
    up = 100 * n // percent >= bounds[band + 1]
    signed = lambda x: int(np.uint64(x).view(np.int64))
    return {"n": n, "s1": signed(s.sum(dtype=np.uint64)), "s2": signed(np.bitwise_xor.reduce(_mix(s ^ _K[0]))), "band": band,
            "own": wide_sketch(s, blocks(band), most_different(n, min(100 * n // percent, bounds[band + 1] - 1), percent)),
            "up": wide_sketch(s, blocks(band + 1), most_different(n, 100 * n // percent, percent)) if up else None,
            "own_bits": sketch(s, short(band)).tolist(), "up_bits": sketch(s, short(band + 1)).tolist() if up else None}


SETS = ("n bigint, s1 bigint, s2 bigint, band int, own array<bigint>, up array<bigint>, own_bits array<bigint>, "
        "up_bits array<bigint>")
SETS_COLUMNS = [c.split()[0] for c in SETS.split(", ")]


def _with_keys(df: DataFrame, keys: DataFrame, cond, how: str = "left_semi") -> DataFrame:
    """Join with a written table of ids: broadcast where it is small by count, else shuffled."""
    return df.join(F.broadcast(keys) if keys.count() <= SMALL_ROWS else keys, cond, how)


def _blocks(nodes: DataFrame) -> DataFrame:
    """(key, node): hash of (layout, block, value) of every block of every class."""
    own = nodes.select("node", "band", F.posexplode("own").alias("i", "v"))
    up = nodes.filter("up is not null").select("node", (F.col("band") + 1).alias("band"), F.posexplode("up").alias("i", "v"))
    return own.unionByName(up).filter("v is not null").select(F.xxhash64("band", "i", "v").alias("key"), "node")


def _meet(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``keys`` (key, m, ...), m being the key's number of rows. Hot keys are broadcast:
    they are at most HOT_SHARE, and the rows of the others are few for each key."""
    limit = max(HOT_ROWS, rows.count() // HOT_SHARE)
    hot = F.broadcast(keys.filter(F.col("m") > limit))
    return rows.join(hot.select("key"), "key", "left_anti").join(keys.filter(F.col("m") <= limit), "key").unionByName(rows.join(hot, "key"))


def _distance(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda t, x: t + x)


class Join:
    """State of one join: classes, their sketches, and the links found so far."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE):
        self.docs, self.percent, self.size = docs, percent, size
        self.rows = land(per_text(docs, [F.col("doc_id").cast("bigint").alias("doc_id")],
                                  lambda texts: _columns([describe(t, percent, size) for t in texts]), SETS, max_bytes=LOT, done=_rest), "near-sets")
        self.classes = land(self.rows.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node")), "near-classes")
        reps = land(self.classes.filter("node is not null").select("node").distinct(), "near-nodes")
        self.nodes = _with_keys(self.rows.filter("n > 0").withColumnRenamed("doc_id", "node"), reps, "node").drop("s1", "s2")

    def buckets(self) -> DataFrame:
        """(key, node) of the blocks that two or more classes share.

        Keys that stand HOT times in a sample of one class in SAMPLE are shared anyhow: their rows need no
        shuffle. All others are few for each key and are counted where they meet."""
        blocks = _blocks(self.nodes)
        sample = _blocks(self.nodes.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0))
        hot = land(sample.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= HOT).select("key"), "near-hot")
        rest = _with_keys(blocks, hot, "key", "left_anti")
        shared = rest.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("c > 1").drop("c")
        return land(shared.unionByName(_with_keys(blocks, hot, "key")), "near-buckets")

    def sketches(self, buckets: DataFrame) -> DataFrame:
        some = land(buckets.select("node").distinct(), "near-some")
        return land(_with_keys(self.nodes, some, "node").select("node", "n", "band", "own_bits", "up_bits").distinct(), "near-sketches")

    def close(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and sketch distance allow a link."""
        p = self.percent
        s = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("band").alias(f"band{x}"), F.col("own_bits").alias(f"own{x}"), F.col("up_bits").alias(f"up{x}"))
        sizes = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"))
        pairs = pairs.join(sizes("a"), "a").join(sizes("b"), "b").filter(
            (F.col("na") * 100 >= F.col("nb") * p) & (F.col("nb") * 100 >= F.col("na") * p)).select("a", "b")
        j = pairs.join(s("a"), "a").join(s("b"), "b")
        layout = F.greatest("banda", "bandb")
        left, right = [F.when(F.col(f"band{x}") == layout, F.col(f"own{x}")).otherwise(F.col(f"up{x}")) for x in "ab"]
        most = F.floor((F.col("na") + F.col("nb")) * (100 - p) / F.lit(100 + p) + F.lit(1e-9))
        return j.withColumn("_x", left).withColumn("_y", right).filter(_distance("_x", "_y") <= most).select("a", "b").distinct()

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets are linked, by their exact shingles."""
        pairs = land(pairs, "near-pairs")
        some = land(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-some")
        percent, size = self.percent, self.size
        texts = _with_keys(self.docs.select(F.col("doc_id").cast("bigint").alias("node"), "text"), some, "node")
        sets = per_text(texts, [F.col("node")], lambda ts: {"s": [shingle_set(t, size).tobytes() for t in ts]}, "s binary", max_bytes=LOT, done=_rest)
        sets = land(sets.filter(F.length("s") > 0).distinct(), "near-verify")
        j = (pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
             .join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b"))

        def test(batches):
            for batch in batches:
                for part in light_batches([batch], "x", LOT):
                    a, b = part.column("x").to_pylist(), part.column("y").to_pylist()
                    good = [linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(a, b)]
                    yield part.select(["a", "b"]).filter(pa.array(good, type=pa.bool_()))

        return land(j.select("a", "b", "x", "y").mapInArrow(test, "a bigint, b bigint").distinct(), "near-links")

    def add(self, links: DataFrame, roots: DataFrame | None) -> DataFrame:
        """(node, root) after merging links into the components so far."""
        known = links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        return components(known)

    def find(self) -> DataFrame:
        """(node, root) of the classes that are linked with another."""
        todo = self.buckets()
        free_shuffles(todo)
        sketches = self.sketches(todo)
        roots = None
        for r in range(STAR_ROUNDS):
            # a centre for each bucket: the least node once the bits of a constant are flipped, another in each round
            turn = F.lit((r * 0x5DEECE66D2B79F35) & 0x7FFFFFFFFFFFFFFF)
            centre = todo.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(turn)).alias("c"), F.count(F.lit(1)).alias("m"))
            met = land(_meet(todo, land(centre.withColumn("c", F.col("c").bitwiseXOR(turn)), "near-centre")).drop("m"), "near-centres")
            pairs = met.filter("node <> c").select(
                F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
            if roots is not None:
                pairs = self._apart(pairs, roots)
            links = self.verify(self.close(pairs, sketches))
            free_shuffles(links)
            roots = self.add(links, roots)
            # the centre is done with in its bucket; buckets within one component are done with
            left = met.filter("node <> c").select("key", "node")
            todo = self._open(left, roots)
            free_shuffles(todo)
            if todo.isEmpty():
                return roots
        return self.add(self.verify(self._pairs(todo, sketches, roots)), roots)

    def links(self) -> DataFrame:
        """(a, b): all linked pairs of classes, by their representatives."""
        buckets = self.buckets()
        return self.verify(self._pairs(buckets, self.sketches(buckets), None))

    def _root(self, df: DataFrame, column: str, roots: DataFrame | None, out: str) -> DataFrame:
        if roots is None:
            return df.withColumn(out, F.col(column))
        r = roots.select(F.col("node").alias(column), F.col("root").alias(out))
        return df.join(r, column, "left").withColumn(out, F.coalesce(out, column))

    def _apart(self, pairs: DataFrame, roots: DataFrame) -> DataFrame:
        both = self._root(self._root(pairs, "a", roots, "_ra"), "b", roots, "_rb")
        return both.filter("_ra <> _rb").select("a", "b")

    def _open(self, buckets: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows of the buckets that span two or more components."""
        rows = land(self._root(buckets, "node", roots, "root"), "near-left")
        spread = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"))
        spread = land(spread.filter("lo <> hi").select("key", "m"), "near-spread")
        return land(_meet(rows.select("key", "node"), spread).drop("m"), "near-open")

    def _pairs(self, buckets: DataFrame, sketches: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Pairs of the remaining buckets that lie in different components and within sketch distance."""
        sizes = land(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "near-sizes")
        rows = land(_meet(self._root(buckets, "node", roots, "root"), sizes), "near-rows")
        side = lambda x: rows.filter(F.col("m") <= PAIRS).select("key", F.col("node").alias(x), F.col("root").alias(f"r{x}"))
        pairs = side("a").join(side("b"), "key").filter("a < b and ra <> rb").select("a", "b").distinct()
        found = self.close(land(pairs, "near-proposed"), sketches)
        large = rows.filter(F.col("m") > PAIRS)
        return found if large.isEmpty() else found.unionByName(self._tiles(large, sketches)).distinct()

    def _tiles(self, rows: DataFrame, sketches: DataFrame) -> DataFrame:
        percent = self.percent
        rows = rows.withColumn("parts", F.ceil(F.col("m") / F.lit(TILE)).cast("int")).drop("m")
        rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("parts")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        rows = rows.withColumn("_o", other).select(
            "key", "node", "root", "part", F.least("part", "_o").alias("lo"), F.greatest("part", "_o").alias("hi"))
        # the bucket's layout is the largest band in it or, if all lie below, the next one: both sketches travel
        rows = rows.join(sketches, "node")

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
            found = []
            for layout in sorted({int(b) for b in pdf["band"]} | {int(b) + 1 for b in pdf["band"]}):
                mine = pdf[(pdf["band"] == layout) | (pdf["band"] + 1 == layout) & pdf["up_bits"].notna()]
                if len(mine) < 2:
                    continue
                words = np.stack([np.asarray(o if b == layout else u, dtype=np.int64).view(np.uint64)
                                  for b, o, u in zip(mine["band"], mine["own_bits"], mine["up_bits"])])
                node, root, n = mine["node"].to_numpy(), mine["root"].to_numpy(), mine["n"].to_numpy()
                part = mine["part"].to_numpy()
                left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
                lot = max(1, (1 << 20) // max(1, len(right) * words.shape[1]))
                for k in range(0, len(left), lot):
                    i, j = left[k:k + lot, None], right[None, :]
                    ok = (root[i] != root[j]) & (n[j] * 100 >= n[i] * percent) & (n[i] * 100 >= n[j] * percent)
                    ok &= node[j] > node[i] if lo == hi else True
                    i, j = (np.broadcast_to(x, ok.shape)[ok] for x in (i, j))
                    d = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
                    near = d <= (n[i] + n[j]) * (100 - percent) // (100 + percent)
                    a, b = node[i[near]], node[j[near]]
                    found += zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        return rows.groupBy("key", "lo", "hi").applyInPandas(compare, "a bigint, b bigint").distinct()


def _columns(rows: list[dict]) -> dict:
    return {k: [r[k] for r in rows] for k in SETS_COLUMNS}


def join(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    j = Join(docs, percent, size)
    roots = j.find()
    named = j._root(j.classes, "node", roots, "root").select("n", "s1", "s2", "root")
    rows = j.rows.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def links(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b) between the representatives of different sets, and membership (doc_id, n_shingles, class_id).

    A class is the rows with one set, its id (and its representative) the least id; rows without a set have a null
    class, and classes without an id take no part in links."""
    j = Join(docs, percent, size)
    named = j.classes.select("n", "s1", "s2", F.col("node").alias("class_id"))
    rows = j.rows.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    return j.links(), rows.select("doc_id", F.col("n").alias("n_shingles"), "class_id")


def keep_one(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component: that of the component's least id.

    Ids that are null or stand in several rows name no row: the rows are then joined by a key of id and text."""
    if _named(docs):
        drop = land(join(docs, percent, size).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
        return _with_keys(docs, drop, docs["doc_id"].cast("bigint") == drop["_gone"], "left_anti")
    key, keys = _keyed(docs)
    rows = docs.withColumn("_near_key", key)
    found = land(join(rows.select(F.col("_near_key").alias("doc_id"), "text"), percent, size).distinct(), "near-found")
    all_ = keys.join(found.withColumnRenamed("doc_id", "_near_key"), "_near_key")
    least = all_.groupBy("component_id").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.col("id").isNull(), "id", "_near_key")).alias("_least"))
    least = land(least.filter("m > 1").select("component_id", F.col("_least._near_key").alias("_stays")), "near-least")
    drop = land(_with_keys(all_, least, "component_id", "inner").filter("_near_key <> _stays").select("_near_key"), "near-gone")
    kept = _with_keys(rows, drop, "_near_key", "left_anti")
    # equal rows are one document, but without an id only if they have a text
    equal = land(all_.filter("c > 1 and (id is not null or n_shingles > 0)").select("_near_key"), "near-equal")
    once = _with_keys(kept, equal, "_near_key", "left_anti")
    return once.unionByName(_with_keys(kept, equal, "_near_key").dropDuplicates(["_near_key"])).drop("_near_key")


def _named(docs: DataFrame) -> bool:
    """Whether each row has an id of its own."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or doc_id is null").isEmpty()


def _keyed(docs: DataFrame):
    """A key of id and text that different rows do not share, and (_near_key, c, id): its rows and their id."""
    # null and the empty text differ
    parts = [x for c in ("doc_id", "text") for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    other = F.xxhash64(F.lit(-1), *parts)
    for turn in range(8):
        key = F.xxhash64(F.lit(turn), *parts)
        keys = land(docs.select(key.alias("_near_key"), other.alias("o"), F.col("doc_id").cast("bigint").alias("id")).groupBy("_near_key").agg(
            F.count(F.lit(1)).alias("c"), F.min("id").alias("id"), F.min("o").alias("lo"), F.max("o").alias("hi")), "near-keys")
        if keys.filter("lo <> hi").isEmpty():
            return key, keys.select("_near_key", "c", "id")
    raise RuntimeError("rows share their 64-bit keys under every seed")
