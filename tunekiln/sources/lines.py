"""Line sources: JSONL / text files read as numbered lines, without a global sort.

Line numbers follow the file: a split's first line number is the running count of the
lines in the earlier splits of the same file. The only data moved for the numbering is a
table with one row per file split.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import join_on
from ..functions.text import is_blank, py_strip

RANGE_ROWS = 1_000_000              # rows of a range when rows are numbered, about
PIECE = 1 << 20                     # bytes of joined digests in a row, about
LEAST_RANGES, MOST_RANGES = 8, 4096


def _scan_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their split, position and the split's offsets (lines / non-blank lines before it).

    The offsets table has one row per file split; AQE turns its join into a broadcast when the
    measured table is under spark.sql.adaptive.autoBroadcastJoinThreshold, else it stays a
    shuffle join of that small table."""
    df = (
        spark.read.text(path)
        .select(
            F.col("value").alias("raw"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_mid"),
        )
        .withColumn("_nb", (~is_blank(F.col("raw"))).cast("int"))
    )
    splits = df.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_nb").alias("_n_nb"), F.min("_mid").alias("_min_mid")
    )
    w = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "_file", "_block", "_min_mid",
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"),
        F.coalesce(F.sum("_n_nb").over(w), F.lit(0)).alias("_off_nb"),
    )
    j = df.join(splits, ["_file", "_block"])
    return j.withColumn("line_no", F.col("_off") + F.col("_mid") - F.col("_min_mid") + 1)


def read_lines(spark: SparkSession, path: str | list[str], slice_col: str = "slice",
               nonblank_numbers: bool = True) -> DataFrame:
    """UTF-8 lines of text files as ``(slice, line_no, nb_no, raw)``; blank lines dropped.

    ``line_no`` counts physical lines (blank ones too) from 1 per file; it needs no shuffle
    of the lines. ``nb_no`` counts non-blank lines only; it needs the lines of a split in one
    task (a shuffle on the split key, bounded by the split size), so it can be switched off
    (``nonblank_numbers_of`` numbers a few chosen lines without it). ``slice`` is the file path.
    """
    j = _scan_lines(spark, path)
    if nonblank_numbers:
        # running count of non-blank lines within the split (groups are one split each)
        w_in = Window.partitionBy("_file", "_block").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
        nb_no = F.col("_off_nb") + F.sum("_nb").over(w_in)
    else:
        nb_no = F.lit(None).cast("bigint")
    out = j.select(F.col("_file").alias(slice_col), "line_no", nb_no.alias("nb_no"), "raw", "_nb")
    return out.filter(F.col("_nb") == 1).drop("_nb")


def read_questions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Question file: non-blank lines, numbered from 1 among non-blank lines, stripped."""
    return read_lines(spark, path).select(
        "slice", F.col("nb_no").alias("q_no"), py_strip(F.col("raw")).alias("question")
    )


def read_question_parts(spark: SparkSession, path: str) -> DataFrame:
    """A question file written as a folder of part files in order, as ``read_questions`` reads one file.

    The numbers of a part are shifted by the questions of the parts before it: one row for each part."""
    q = read_questions(spark, path)
    part = F.regexp_extract("slice", "/part-([0-9]+)[^/]*$", 1).cast("bigint")
    parts = q.groupBy("slice").agg(F.count(F.lit(1)).alias("_n")).withColumn("_part", part)
    before = F.sum("_n").over(Window.orderBy("_part", "slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("slice", F.coalesce(before, F.lit(0)).alias("_off"))
    return q.join(offsets, "slice").select("slice", (F.col("q_no") + F.col("_off")).alias("q_no"), "question")


def _cuts(df: DataFrame, key: Column, buckets: int) -> list:
    """Up to ``buckets`` - 1 values that cut ``key`` into ranges of about equal counts, from a sample of
    its values by hash (about 32 for each bucket). Any cuts give the same numbers; these balance the work."""
    values = df.select(key.alias("_k")).filter("_k is not null")
    total = values.count()
    every = max(1, total // (buckets * 32))
    some = sorted(r["_k"] for r in values.filter(F.pmod(F.xxhash64("_k"), F.lit(every)) == 0).distinct().limit(buckets * 1024).collect())
    return sorted({some[i * len(some) // buckets] for i in range(1, buckets)}) if some else []


def _range_of(key: Column, cuts: list, a: int, b: int) -> Column:
    """Number of ``cuts`` at or below ``key``, by halving; a null key is in range 0."""
    if a == b:
        return F.lit(a)
    m = (a + b) // 2
    return F.when(key >= F.lit(cuts[m]), _range_of(key, cuts, m + 1, b)).otherwise(_range_of(key, cuts, a, m))


def by_ranges(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """``df`` with ``_b``, the number of the range of ``key`` (RANGE_ROWS rows or so) that a row lies in."""
    if buckets is None:
        buckets = min(MOST_RANGES, max(LEAST_RANGES, -(-df.count() // RANGE_ROWS)))
    cuts = _cuts(df, F.col(key), buckets)
    return df.withColumn("_b", _range_of(F.col(key), cuts, 0, len(cuts)))


def number_rows(df: DataFrame, order_col: str, by: list[str] | None = None, out: str = "row_no",
                bucket_key: Column | None = None, buckets: int | None = None) -> DataFrame:
    """1-based position of each row by ``order_col`` inside each group of ``by`` (null groups count as one group).

    Only the keys are numbered: they are ranked inside (group, range of the order) and shifted by the counts of
    the group's earlier ranges, and the numbers are then joined to the rows, which move only if the numbers are
    too many to broadcast. The ranges (by default of about RANGE_ROWS rows) are cut from a sample of the order
    values, so they are balanced for dense, sparse and text ids alike, and a hot group spreads over all of them;
    the cuts do not enter the result. Rows that share an order value within a group follow each other in any
    order. ``bucket_key`` (default: the order column) is what the ranges are cut by where the order is a struct;
    it must be ordered as the order column is.
    """
    by = by or []
    key = bucket_key if bucket_key is not None else F.col(order_col)
    ids = df.select(*by, order_col, key.alias("_cut"))
    # the count of a repeated key keeps its place for each of its rows
    d = by_ranges(ids, "_cut", buckets).groupBy(*by, "_b", order_col).agg(F.count(F.lit(1)).alias("_c"))
    counts = d.groupBy(*by, "_b").agg(F.sum("_c").alias("_n"))
    # at most ``buckets`` rows for each group
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_b").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    ranked = d.withColumn("_r", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    # one row per (group, range); AQE broadcasts it when its measured size is small
    numbers = join_on(ranked, offsets, by + ["_b"]).select(*by, order_col, (F.col("_off") + F.col("_r")).cast("bigint").alias("_first"), "_c")
    joined = join_on(df, numbers, [*by, order_col])
    if ids.groupBy(*by, order_col).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").isEmpty():
        return joined.withColumn(out, F.col("_first") + 1).drop("_first", "_c")
    # only the rows that share their key are ranked among each other
    among = F.row_number().over(Window.partitionBy(*by, order_col).orderBy("_first"))
    one = joined.filter("_c = 1").withColumn(out, F.col("_first") + 1)
    more = joined.filter("_c > 1").withColumn(out, (F.col("_first") + among).cast("bigint"))
    return one.unionByName(more).drop("_first", "_c")


def multiset_digest(text: Column) -> Column:
    """Aggregate: a digest of a group's texts that does not depend on their order, as one plain partial sum.

    It is the md5 of the number of texts and of the sums of the four 32-bit pieces of their md5 digests."""
    d = F.md5(text)
    pieces = [F.sum(F.conv(F.substring(d, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return F.md5(F.concat_ws("|", F.count(text).cast("string"), *pieces))


def sorted_digest(counts: DataFrame, by: str, key: str, n: str, out: str) -> DataFrame:
    """(``by``, ``out``): md5 of each group's digests ``key``, sorted and joined, each as often as ``n`` says.

    The digests are sorted in ranges, by many tasks, and joined to pieces there. A md5 is one chain by its nature: the
    pieces of a group are read one after the other, and none is held longer than it is read."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = counts.select(F.col(by), F.col(key).alias("_k"), F.col(n).alias("_c")).repartitionByRange(parts, by, "_k").sortWithinPartitions(by, "_k")

    def join(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for group, k, c in zip(*[x.to_pylist() for x in batch.columns]):
                while c:
                    if not rows or rows[-1][0] != group or len(rows[-1][2]) >= PIECE:
                        at += 1
                        rows.append((group, at, bytearray()))
                    take = min(c, PIECE // len(k))
                    rows[-1][2].extend(k.encode() * take)
                    c -= take
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([part] * len(rows), pa.int32()),
                                              pa.array([r[1] for r in rows], pa.int64()), pa.array([bytes(r[2]) for r in rows], pa.binary())],
                                             names=[by, "_part", "_at", "_piece"])

    kind = counts.schema[by].dataType.simpleString()
    pieces = spread.mapInArrow(join, f"`{by}` {kind}, _part int, _at bigint, _piece binary")

    def chain(batches):
        group, md5 = None, None

        def row(arrow):
            return pa.RecordBatch.from_arrays([pa.array([group], arrow), pa.array([md5.hexdigest()])], names=[by, out])
        for batch in batches:
            arrow = batch.schema.field(0).type
            for g, piece in zip(batch.column(0).to_pylist(), batch.column(3)):
                if md5 is not None and g != group:
                    yield row(arrow)
                    md5 = None
                if md5 is None:
                    group, md5 = g, hashlib.md5(usedforsecurity=False)
                md5.update(piece.as_buffer())
        if md5 is not None:
            yield row(arrow)

    return pieces.repartition(parts, by).sortWithinPartitions(by, "_part", "_at").mapInArrow(chain, f"`{by}` {kind}, `{out}` string")


def slice_of_path(path: Column) -> Column:
    """The slice that a ``slice=...`` folder of a file's path names; null for the folder of null slices."""
    name = F.regexp_extract(path, "/slice=([^/]+)/[^/]*$", 1)
    for _ in range(2):  # folder names are escaped, and again where the path is a URI
        name = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return F.when(name != "__HIVE_DEFAULT_PARTITION__", name)


def blank_lines(spark: SparkSession, path: str | list[str], slice_col: str = "slice") -> DataFrame:
    """(slice, line_no) of the blank lines of text files: a narrow table, no line text kept."""
    j = _scan_lines(spark, path)
    return j.filter(F.col("_nb") == 0).select(F.col("_file").alias(slice_col), "line_no")


def nonblank_numbers_of(targets: DataFrame, blanks: DataFrame, slice_col: str = "slice") -> DataFrame:
    """Non-blank line numbers for a few target lines: line_no minus the blank lines before it in
    the same file. Each blank line meets only its own file's targets (a handful per file)."""
    t = targets.select(slice_col, "line_no")
    b = blanks.select(slice_col, F.col("line_no").alias("_blank"))
    before = (t.join(b, slice_col).filter(F.col("_blank") < F.col("line_no"))
              .groupBy(slice_col, "line_no").agg(F.count(F.lit(1)).alias("_before")))
    return (targets.join(before, [slice_col, "line_no"], "left")
            .withColumn("nb_no", F.col("line_no") - F.coalesce(F.col("_before"), F.lit(0))).drop("_before"))
