"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, land  # noqa: F401  (re-exported: written scratch tables)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# ASCII white space, the word separator of most contracts here
SPACE = "[\\x20\\x09-\\x0D]+"


def free_shuffles(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of finished jobs now. It does so when the driver's JVM collects the
    jobs' objects, which a driver with little to do would put off for long."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts`` (null ids: null)."""
    return F.crc32(doc_id.cast("string")) % F.lit(parts)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII characters alone take the faster built-in."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, separators: str = SPACE) -> Column:
    """Words between runs of separators; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def light_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` of ``column`` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i in range(n):
            if i > start and held + sizes[i] > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(sizes[i])
        yield batch.slice(start)


def per_text(docs: DataFrame, keep: list[Column], fn: Callable, schema: str, text: str = "text",
             max_bytes: int = 4 << 20, done: Callable | None = None) -> DataFrame:
    """Apply ``fn(list of texts) -> dict of column values`` to whole texts, in batches of about ``max_bytes`` of text.
    ``done`` is called at the end of a task.

    ``keep`` columns pass through unchanged in front of the columns of ``schema``. Null texts reach
    ``fn`` as None. Only the kept columns and the text are read; nothing is shuffled."""
    kept = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    fields = [f for f in kept.schema.fields if f.name != "_text"]
    from pyspark.sql.types import StructType
    out_schema = StructType(fields + list(StructType.fromDDL(schema).fields))
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out_schema)
    names = [f.name for f in fields]

    def run(batches):
        try:
            for batch in light_batches(batches, "_text", max_bytes):
                made = fn(batch.column("_text").to_pylist())
                cols = [batch.column(n).cast(arrow.field(n).type) for n in names]
                cols += [pa.array(made[f.name], type=f.type) for f in list(arrow)[len(names):]]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        finally:
            if done:
                done()

    return kept.mapInArrow(run, out_schema)
