import hashlib

from conftest import SF01
from pyspark.sql import functions as F

from tunekiln.registry import queries
from tunekiln.sources import lines


def test_digest_of_any_order(spark):
    rows = [("a", f"line {i % 7}") for i in range(40)] + [("a", "often")] * 25 + [("b", "one")] + [("c", f"é{i}") for i in range(6)] + [(None, "x"), ("d", None)]
    df = spark.createDataFrame(rows, "slice string, raw string")
    digest = lines.multiset_digest(F.col("raw")).alias("m")
    got = dict(tuple(r) for r in df.groupBy("slice").agg(digest).collect())

    def want(texts):
        pieces = [hashlib.md5(t.encode()).hexdigest() for t in texts]
        sums = [str(sum(int(m[8 * i:8 * i + 8], 16) for m in pieces)) for i in range(4)] if pieces else []
        return hashlib.md5("|".join([str(len(pieces)), *sums]).encode()).hexdigest()

    assert got == {s: want([t for k, t in rows if k == s and t is not None]) for s in ("a", "b", "c", None, "d")}
    assert got == dict(tuple(r) for r in df.orderBy(F.desc("raw")).repartition(5).groupBy("slice").agg(digest).collect())
    plan = df.groupBy("slice").agg(digest)._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan and "Python" not in plan and "Sort" not in plan


def test_digest_of_sorted_digests(spark, monkeypatch):
    monkeypatch.setattr(lines, "PIECE", 100)  # pieces of three digests
    rows = [("a", f"line {i % 7}") for i in range(40)] + [("a", "often")] * 25 + [("b", "one")] + [(None, "x"), (None, "y")]
    df = spark.createDataFrame(rows, "slice string, raw string").repartition(5)
    counts = df.groupBy("slice", F.md5("raw").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    got = {r["slice"]: r["m"] for r in lines.sorted_digest(counts, "slice", "k", "n", "m").collect()}
    assert got == {s: hashlib.md5("".join(sorted(hashlib.md5(t.encode()).hexdigest() for k, t in rows if k == s)).encode()).hexdigest() for s in ("a", "b", None)}


def test_jsonl_lines_have_the_sorted_digest(spark):
    assert "lines_md5" in queries()["src_jsonl_lines"](spark, SF01).columns


def test_slices_named_by_folders(spark, tmp_path):
    rows = [("a b", "1"), ("x+y%z", "2"), (None, "3"), ("é:/=", "4")]
    spark.createDataFrame(rows, "slice string, value string").write.partitionBy("slice").text(str(tmp_path / "t"))
    back = spark.read.text(str(tmp_path / "t/*/*.txt")).select(lines.slice_of_path(F.col("_metadata.file_path")).alias("s"), "value")
    assert {(r.s, r.value) for r in back.collect()} == set(rows)


def test_no_slice_is_gathered(spark):
    plan = queries()["src_jsonl_lines"](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_questions_are_written_by_many_tasks(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = queries()["src_question_lines"](spark, SF01)
        assert len(out.inputFiles()) > 1
        got = sorted(tuple(r) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    texts = [r["text"] for r in sorted(spark.read.parquet(f"{SF01}/benchmark.parquet").collect())]
    assert got == [(i + 1, t.replace("\r", " ").replace("\n", " ").strip()) for i, t in enumerate(texts)]
