"""Hold-out by bitmap, continuous packing, and overrides of the plan document."""
import json

import pytest
from pyspark.sql import functions as F

from tunekiln.operators import prep
from tunekiln.plans import corpus_plan as pl
from tunekiln.sources.records import samples_from_columns


def test_holdout_equals_the_anti_join(spark, monkeypatch):
    train = spark.range(3000).select("id", F.when(F.col("id") % 50 != 3, F.concat(F.lit("Text "), (F.col("id") % 1500).cast("string"))).alias("text"))
    held = spark.range(0, 3000, 7).select(F.concat(F.lit("tExT"), F.col("id").cast("string")).alias("text")).unionByName(spark.sql("SELECT '' AS text"))
    out = prep.exclude_holdout(train, held)
    want = {i for i in range(3000) if not ((i % 50 == 3) or (i % 1500) % 7 == 0 and i % 1500 < 3000)}
    assert {r.id for r in out.collect()} == want and out.columns == train.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    monkeypatch.setattr(prep, "HOLDOUT_BYTES", 0)
    assert {r.id for r in prep.exclude_holdout(train, held).collect()} == want
    monkeypatch.undo()
    monkeypatch.setattr(prep, "HOLDOUT_BITS", 1)  # many false hits, which the exact join lets pass
    assert {r.id for r in prep.exclude_holdout(train, held).collect()} == want
    assert prep.exclude_holdout(train, held.limit(0)).count() == 3000


@pytest.mark.parametrize("buckets", [1, 7])
def test_packs_of_one_row(spark, buckets):
    rows = [(i, [None, "a", "b"][i % 3] if i % 5 else "a", (i * 37) % 90) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, slice string, tokens int")
    got = prep.pack_continuous(df, "id", "tokens", 64, ["slice"], buckets).collect()
    want = []
    for g in (None, "a", "b"):
        at, own = 0, [(i, t + 1) for i, s, t in rows if s == g]
        total = sum(n for _, n in own)
        for i, n in own:
            start = at
            while at < start + n:
                size = min(start + n, (at // 64 + 1) * 64) - at
                want.append((g, at // 64, i, at - start, size, at % 64, n, (at // 64 + 1) * 64 <= total))
                at += size
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert all(sum(not r.is_full for r in {(r.slice, r.pack): r for r in got}.values() if r.slice == g) <= 1 for g in (None, "a", "b"))


def test_override_documents(spark):
    df = spark.createDataFrame([(i, s, f"instruction {i}", "a reply of some length " * (i % 9 + 1)) for s in ("x", "y", None) for i in range(40)],
                               "sample_id long, slice string, instruction string, output string")
    samples = samples_from_columns(df, instruction="instruction", output="output", keep=["slice", "sample_id"])
    ov = spark.createDataFrame([("x", '{"config": {"rank": {"value": 64}, "unknown": {"value": 1}}, "max_seq_length": 4096}'),
                                (None, '{"config": {"batch_size": {"value": 1}}}'), ("z", "{}")], "slice string, document string")
    docs = lambda o: {r.slice: json.loads(r.document) for r in pl.plan_document(pl.full_plan(samples, ["slice"], overrides=o), ["slice"]).collect()}
    plain, merged = docs(None), docs(ov)
    assert merged["y"] == plain["y"] and set(merged) == {"x", "y", None}
    x = merged["x"]
    assert x["config"]["rank"]["value"] == 64 and x["config"]["rank"]["reason"] == plain["x"]["config"]["rank"]["reason"] + " [用户覆盖]"
    assert x["max_seq_length"] == 4096 and x["memory"]["total"] > plain["x"]["memory"]["total"]
    assert x["config"]["alpha"] == plain["x"]["config"]["alpha"] and "unknown" not in x["config"]
    assert merged[None]["config"]["batch_size"]["value"] == 1 and merged[None]["schedule"]["total_steps"] > plain[None]["schedule"]["total_steps"]
    assert set(plain["y"]) == {"config", "data_summary", "max_seq_length", "memory", "schedule"}
