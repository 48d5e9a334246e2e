"""Merkle manifest of a dataset, with inclusion proofs found by pointer jumping.

Each row is a leaf: H (SHA-256 as lower-case hex) of its fields, each ``-`` if null, else its UTF-8 byte count,
``:`` and its value. In each group (``lang``) leaves ascend by id; while several nodes remain, every FANOUT
consecutive ones become the H of their joined digests. The groups' last nodes (subroots, null group first, then
by bytes) form a tree of the same kind, whose last node is the root.

1. Positions: rows are range-sorted by (group, id, digest) and written; a row's position is its place in its
   part plus the rows of its group in the parts before. Equal rows are spread by a running number.
2. Levels: one aggregation for each level, of at most FANOUT digests a group.
3. Pointers: an inner node starts with a pointer to its parent and one segment, the siblings to its left and
   right. Self-joins replace its pointer by that of the node it points to and append that node's segments, so
   the distance doubles with each join until all point to the root. The nodes pointed to get fewer with the
   distance: where they are proved to be small (count times segment bytes) they are broadcast, else there are
   so many of them that no key is hot.
4. Leaves take the segments of their run's parent in a last self-join; a run's eight leaves share them.

``prove`` gives each leaf its segments, ``fold`` recomputes the root from a leaf and its segments alone.

Defined cases: a null id comes first in its group; rows with one id are ordered by their digests, and equal rows
take a place each; null and empty texts differ (``-`` and ``0:``); null groups form one group; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, land

FANOUT = 8
BROADCAST_BYTES = 32 << 20  # of counted nodes and their segments
DIGEST = 64                 # hex characters
TOP = -1                    # group number of the tree over the subroots
SEGMENTS = "array<struct<l:string,r:string>>"


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def tamper(text: Column) -> Column:
    """The demonstration's damage: A-Z become lower case."""
    return F.translate(text, UPPER, LOWER)


def height(n: Column) -> Column:
    """Levels above n leaves: how often n divided by FANOUT and rounded up gives more than nothing to join."""
    return sum(((n > F.lit(FANOUT ** k)).cast("int") for k in range(1, 21)), (n > 1).cast("int"))


def _sorted_parts(rows: DataFrame, by: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` range-sorted and written, and the runs of each group in each part: (_part, ``by``, _first, _n,
    _base), where _base counts the group's rows in the parts before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [*by, *order, "_spread"]
    rows = rows.withColumn("_spread", F.xxhash64(F.monotonically_increasing_id()))
    rows = rows.repartitionByRange(n, *sort).sortWithinPartitions(*sort).drop("_spread")
    rows = land(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    runs = rows.groupBy(_part().alias("_part"), *by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # a group has a row for each part at most
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, land(runs.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))), name + "-runs")


def _part() -> Column:
    return F.shiftright("_at", 33).cast("int")  # the high bits of the running number are the part's number


def _placed(rows: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with their group's columns of ``runs`` and ``pos``, the 0-based place in the group. No key has more
    rows than a part."""
    on = F.shiftright(rows["_at"], 33).cast("int") == runs["_part"]
    for c in by:
        on = on & rows[c].eqNullSafe(runs[c])
    j = rows.join(runs, on).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_base"))
    return j.select(*[rows[c] for c in rows.columns if c != "_at"], *[runs[c] for c in runs.columns if c not in by and c[0] != "_"], "pos")


def _node(level, g: str = "g", pos: str = "pos") -> list[Column]:
    """Id columns of a node at ``level`` of a group of height h; a group's last node is a leaf of the top tree."""
    last = (F.col("h") <= level) & (F.col(g) != TOP)
    return [F.when(last, F.lit(TOP)).otherwise(F.col(g)).cast("bigint").alias("g"), F.when(last, 0).otherwise(F.lit(level)).cast("int").alias("level"),
            F.when(last, F.col(g)).otherwise(F.col(pos)).cast("bigint").alias("pos")]


def _grow(nodes: DataFrame, first: int, upto: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Build the levels above ``nodes`` (g, h, pos, digest), which stand at level ``first``.

    Gives each group's last node, and for each level its nodes with their pointer and segment."""
    last, found = nodes.filter(F.col("h") <= first), []
    for level in range(first, upto):
        runs = nodes.filter(F.col("h") > level).groupBy("g", "h", F.floor(F.col("pos") / FANOUT).cast("bigint").alias("run")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("own"))
        runs = runs.withColumn("joined", F.array_join(F.transform("own", lambda x: x["digest"]), ""))
        runs = land(runs.withColumn("parent", F.sha2("joined", 256)), f"{name}-{level}")
        each = runs.select("g", "h", "run", "joined", "parent", F.posexplode("own").alias("i", "x"))
        found.append(each.select(
            "g", F.lit(level).cast("int").alias("level"), F.col("x.pos").alias("pos"), F.struct(*_node(level + 1, pos="run")).alias("up"),
            _segment(F.col("i"), F.col("joined")).alias("seg"), _subroot(level).alias("sub")))
        nodes = runs.select("g", "h", F.col("run").alias("pos"), F.col("parent").alias("digest"))
        last = last.unionByName(nodes.filter(F.col("h") == level + 1))
    return last, found


def _subroot(level: int) -> Column:
    """A node's subroot, where the node or its parent is one."""
    top = F.col("g") == TOP
    return F.when(top & F.lit(level == 0), F.col("x.digest")).when(~top & (F.col("h") == level + 1), F.col("parent"))


def _segment(i: Column, joined: Column) -> Column:
    """The siblings to the left and right of the i-th digest of a run, as an array of one segment."""
    left, right = joined.substr(F.lit(1), i * DIGEST), joined.substr((i + 1) * DIGEST + 1, F.lit(FANOUT * DIGEST))
    return F.array(F.struct(left.alias("l"), right.alias("r"))).cast(SEGMENTS)


def _jump(nodes: DataFrame, distance: int, name: str) -> DataFrame:
    """One self-join: pointers of twice the distance, with the segments of both halves."""
    aims = land(nodes.select("up.g", "up.level", "up.pos").distinct(), name + "-aims")
    small = aims.count() * (distance * FANOUT * DIGEST + 200) <= BROADCAST_BYTES
    there = nodes.join(F.broadcast(aims) if small else aims, ["g", "level", "pos"], "left_semi").select(
        F.struct("g", "level", "pos").alias("up"), F.col("up").alias("up2"), F.col("seg").alias("seg2"), F.col("sub").alias("sub2"))
    j = nodes.join(F.broadcast(there) if small else there, "up")
    return land(j.select("g", "level", "pos", F.col("up2").alias("up"), F.concat("seg", "seg2").alias("seg"), F.coalesce("sub", "sub2").alias("sub")), name)


def prove(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, changed, subroot, root, path): every leaf with its segments up to the root.

    ``changed`` is the leaf's digest after ``tamper``, for the rows that the demonstration damages, else null."""
    col = {c: F.col(c) for c in ("source", "lang", "n_chars", "text")} | {"doc_id": F.col("doc_id").cast("bigint")}
    hit = F.coalesce(F.crc32(col["doc_id"].cast("string")) % 3 == 0, F.lit(False))
    rows = land(docs.select(col["doc_id"].alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf_digest(**col).alias("leaf"),
                            F.when(hit, leaf_digest(**col | {"text": tamper(col["text"])})).alias("changed")), "merkle-rows")
    leaves, runs = _sorted_parts(rows, ["lang"], ["doc_id", "leaf"], "merkle-leaves")
    # number the groups and give their numbers and heights to the runs
    groups, parts = _sorted_parts(runs.groupBy("lang").agg(F.sum("_n").alias("n")), [], ["lang"], "merkle-groups")
    groups = land(_placed(groups, parts, []).select("lang", height(F.col("n")).alias("h"), F.col("pos").alias("g")), "merkle-heights")
    size = groups.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("h"), F.lit(0)).alias("h")).first()
    named = runs.join(groups, runs["lang"].eqNullSafe(groups["lang"])).select(runs["*"], "g", "h")
    # the lowest runs keep their leaves; a lone leaf is its group's subroot and has no run
    own = F.array_sort(F.collect_list(F.struct("pos", "leaf", "doc_id", "changed")))
    low = _placed(leaves, named, ["lang"]).groupBy("g", "h", F.floor(F.col("pos") / FANOUT).cast("bigint").alias("run")).agg(own.alias("own"))
    low = low.withColumn("joined", F.array_join(F.transform("own", lambda x: x["leaf"]), ""))
    low = land(low.withColumn("parent", F.when(F.col("h") == 0, F.col("joined")).otherwise(F.sha2("joined", 256))), "merkle-low")
    subroots, nodes = _grow(low.select("g", "h", F.col("run").alias("pos"), F.col("parent").alias("digest")), 1, size["h"], "merkle-inner")
    top = 0
    while FANOUT ** top < size["n"]:
        top += 1
    subroots = land(subroots.select(F.lit(TOP).cast("bigint").alias("g"), F.lit(top).alias("h"), F.col("g").alias("pos"), "digest"), "merkle-subroots")
    last, above = _grow(subroots, 0, top, "merkle-top")
    last = last.select("digest").first()  # one row, none for an empty table
    root = F.lit(last["digest"] if last else None).cast("string")
    ids = [F.lit(TOP).cast("bigint").alias("g"), F.lit(top).cast("int").alias("level"), F.lit(0).cast("bigint").alias("pos")]
    every = low.sparkSession.range(1).select(*ids, F.struct(*ids).alias("up"), F.array().cast(SEGMENTS).alias("seg"), (root if top == 0 else F.lit(None).cast("string")).alias("sub"))
    for level in nodes + above:
        every = every.unionByName(level)
    every = land(every, "merkle-nodes")
    reach = 1
    while reach < max(0, size["h"] - 1) + top:
        every, reach = _jump(every, reach, f"merkle-jump-{reach}"), 2 * reach
    held = low.select(*_node(1, pos="run"), "own", F.when(F.col("h") > 0, F.col("joined")).alias("run"))
    each = held.join(every.select("g", "level", "pos", "seg", "sub"), ["g", "level", "pos"]).select(F.posexplode("own").alias("i", "x"), "run", "seg", "sub")
    path = F.when(F.col("run").isNull(), F.col("seg")).otherwise(F.concat(_segment(F.col("i"), F.col("run")), "seg"))
    return each.select("x.doc_id", "x.leaf", "x.changed", F.col("sub").alias("subroot"), root.alias("root"), path.alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its segments lead to."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["l"], d, s["r"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def verify(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    p = prove(docs).withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return p.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified"))


# crc32 by its bits: DuckDB has no such function. Each step folds one bit of the decimal id into the sum.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(d) + 1),
            lambda i: list_prepend(ascii(d[i])::BIGINT, [-1::BIGINT, -1, -1, -1, -1, -1, -1])))),
            lambda c, b: CASE WHEN b >= 0 THEN CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) // 2, 3988292384) ELSE xor(c, b) // 2 END
                              WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"""


def _leaf_sql(text: str) -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLE = f"""
WITH RECURSIVE d AS (SELECT *, coalesce(doc_id::VARCHAR, '') AS d FROM documents),
lv AS (SELECT doc_id, lang, {_leaf_sql('text')} AS leaf,
        CASE WHEN doc_id IS NOT NULL AND xor({_CRC}, 4294967295) % 3 = 0
             THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM d),
p0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM lv),
low AS (
  SELECT 0 AS level, g, pos, leaf AS digest, n FROM p0
  UNION ALL
  SELECT level + 1, g, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM low WHERE n > 1 GROUP BY level, g, pos // 8),
sub AS (SELECT g, digest, level FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, g AS pos, digest, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM high WHERE n > 1 GROUP BY level, pos // 8),
nodes AS (SELECT level, g, pos, digest, n FROM low WHERE n > 1
  UNION ALL SELECT h.level + 100, -1, h.pos, h.digest, h.n FROM high h WHERE h.n > 1),
sib AS (SELECT level, g, pos,
   coalesce(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY level, g, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
   coalesce(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY level, g, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM nodes),
climb AS (
  SELECT row_number() OVER () AS id, 0 AS step, g, CASE WHEN n = 1 THEN 100 ELSE 0 END AS level, CASE WHEN n = 1 THEN -1 ELSE g END AS at,
         CASE WHEN n = 1 THEN g ELSE pos END AS pos, coalesce(changed, leaf) AS digest, '' AS proof, doc_id, leaf FROM p0
  UNION ALL
  SELECT c.id, c.step + 1, c.g, CASE WHEN c.at >= 0 AND c.level + 1 = s.level THEN 100 ELSE c.level + 1 END,
         CASE WHEN c.at >= 0 AND c.level + 1 = s.level THEN -1 ELSE c.at END,
         CASE WHEN c.at >= 0 AND c.level + 1 = s.level THEN c.g ELSE c.pos // 8 END,
         sha256(b.l || c.digest || b.r), c.proof || b.l || b.r, c.doc_id, c.leaf
  FROM climb c JOIN sib b ON b.level = c.level AND b.g = c.at AND b.pos = c.pos JOIN sub s ON s.g = c.g),
root AS (SELECT digest FROM high WHERE n = 1)
SELECT doc_id, leaf, s.digest AS subroot, root.digest AS root, sha256(proof) AS proof_sha256, c.digest AS folded_root,
       c.digest = root.digest AS verified
FROM (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY id ORDER BY step DESC) = 1) c JOIN sub s ON s.g = c.g CROSS JOIN root
"""
