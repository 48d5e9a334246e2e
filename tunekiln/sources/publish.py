"""Publication of a result as a whole: readers see the earlier output or the new one, never a part of either.

Each publication writes a version folder of its own, with Spark's usual tasks and their commits; only when that
job has ended is the pointer file replaced, by one atomic rename. A job that fails, or is killed, leaves the pointer as
it was; a job that is repeated writes another version. The version before the current one stays for readers that
have opened it; older ones, and folders of failed jobs, are deleted by the next publication.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_CURRENT"
VERSION = re.compile(r"_v-[0-9]{8}-[0-9a-f]{12}")


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, root, root.getFileSystem(conf)


def _versions(jvm, root, fs) -> list[str]:
    if not fs.exists(root):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(root) if VERSION.fullmatch(s.getPath().getName()))


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the published version; None before the first publication."""
    jvm, conf, root, fs = _files(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(root, POINTER)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        name = stream.readUTF()
    finally:
        stream.close()
    return f"{path.rstrip('/')}/{name}"


def publish(df: DataFrame, path: str, fmt: str = "json", partition_by: list[str] | None = None) -> str:
    """Write ``df`` as a new version under ``path`` and make it the published one; returns the version's folder."""
    spark = df.sparkSession
    jvm, conf, root, fs = _files(spark, path)
    before = current(spark, path)
    taken = _versions(jvm, root, fs)
    number = max([int(v[3:11]) for v in taken], default=0) + 1
    name = f"_v-{number:08d}-{uuid.uuid4().hex[:12]}"
    df.write.format(fmt).mode("errorifexists").partitionBy(*(partition_by or [])).save(f"{path.rstrip('/')}/{name}")
    _point(jvm, conf, root, fs, name)
    for old in taken:
        if before is None or not before.endswith("/" + old):
            fs.delete(jvm.org.apache.hadoop.fs.Path(root, old), True)
    return f"{path.rstrip('/')}/{name}"


def _point(jvm, conf, root, fs, name: str) -> None:
    """Replace the pointer by one rename: a reader sees the old name or the new one."""
    hadoop = jvm.org.apache.hadoop.fs
    temp = hadoop.Path(root, f".{POINTER}-{name}")
    out = fs.create(temp, True)
    out.writeUTF(name)
    out.close()
    how = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    jvm.java.lang.reflect.Array.set(how, 0, hadoop.Options.Rename.OVERWRITE)
    where = hadoop.FileContext.getFileContext(fs.getUri(), conf)
    where.rename(fs.makeQualified(temp), fs.makeQualified(hadoop.Path(root, POINTER)), how)


def replace(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write ``df`` beside ``path`` and put it in the place of that folder, for readers that know no pointer.

    A job that fails leaves ``path`` as it was. Two renames put the new folder there; between them there is none."""
    spark, tag = df.sparkSession, uuid.uuid4().hex[:12]
    jvm, conf, root, fs = _files(spark, path.rstrip("/"))
    new, old = (jvm.org.apache.hadoop.fs.Path(root.getParent(), f".{root.getName()}-{k}-{tag}") for k in ("new", "old"))
    try:
        df.write.format(fmt).mode("errorifexists").partitionBy(*(partition_by or [])).save(new.toString())
        there = fs.exists(root)
        if there and not fs.rename(root, old):
            raise OSError(f"cannot move {path} aside")
        if not fs.rename(new, root):
            if there:
                fs.rename(old, root)
            raise OSError(f"cannot put the new folder at {path}")
    except Exception:
        fs.delete(new, True)
        raise
    fs.delete(old, True)


def read_published(spark: SparkSession, path: str, fmt: str = "json", schema: str | None = None) -> DataFrame:
    """The published version of ``path``."""
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"nothing is published under {path}")
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(folder)
