import math
import random

import duckdb
import numpy as np
import pytest
from conftest import SF001
from pyspark.sql import functions as F

import __spark_entry__ as E
from tunekiln.llm import impact_index as ix

SCHEMA = "vec_id bigint, embedding array<float>, label int, score int, q int, shard int, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, "x") for i, v in rows], SCHEMA)


def brute(rows, step=20):
    good = {(i, tuple(np.trim_zeros([math.floor(64 * float(np.float32(x))) for x in v], "b"))) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in good:
        if a[0] % step == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a[1], b[1])), b[0]) for b in good if b != a))[:20]
            out += [(a[0], k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    return sorted(out)


def rows_of(seed, n=700, dims=12):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [x * 0.2 + rng.gauss(0, 0.1) for x in c]))
    for i in range(n, n + 200):  # one vector in very many rows
        rows.append((i, rows[7][1]))
    return rows


@pytest.mark.parametrize("shard,lot,scale", [(100, 16, 1.0), (4096, 512, 1.0), (60, 7, 900.0)])
def test_against_brute_force(spark, monkeypatch, shard, lot, scale):
    monkeypatch.setattr(ix, "SHARD", shard)
    monkeypatch.setattr(ix, "LOT", lot)
    rows = [(i, [x * scale for x in v]) for i, v in rows_of(shard)]
    got = sorted(map(tuple, ix.search(frame(spark, rows), ix.query_rows()).collect()))
    assert got == brute(rows)  # recall 1, and the ranks


def test_hot_queries_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ix, "HOT", 3)
    rows = rows_of(5, 300)
    assert sorted(map(tuple, ix.search(frame(spark, rows), ix.query_rows()).collect())) == brute(rows)


def test_the_proof_leaves_out_segments():
    """What stops early still holds all members, also for a bound that is reached exactly."""
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(0, 8, (900, 24))).astype(np.int64)
    w = v[:40]
    segments = [(a, np.frombuffer(b, "<u4").reshape(-1, 2), np.frombuffer(c, "<u4").astype(np.int64)) for a, b, c in ix._segments(v)]
    assert [s[0] for s in segments] == sorted((s[0] for s in segments), reverse=True)
    assert sum(len(s[2]) for s in segments) == np.count_nonzero(v)
    want = w @ v.T
    least = np.sort(want, axis=1)[:, -21]
    for start in (np.full(40, -(1 << 63)), least):
        i, q, s = ix._search(v, segments, w, start)
        assert (s == want[q, i]).all()
        have = set(zip(q.tolist(), i.tolist()))
        assert all((a, b) in have for a in range(40) for b in np.flatnonzero(want[a] >= least[a]).tolist())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (0, [0.5, 0.25]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]),
            (5, []), (6, [0.5]), (7, [0.5, 0.25, 0.0]), (20, [-0.3, 0.7, 0.2]), (20, [0.9, 0.9]), (40, []), (60, None), (8, [1e30, 0.0])]
    rows = rows[:-1]
    assert sorted(map(tuple, ix.search(frame(spark, rows), ix.query_rows()).collect())) == brute(rows)
    assert ix.search(frame(spark, rows[-3:] + [(8, [1e30])]), ix.query_rows()).count() == 4
    assert ix.search(frame(spark, []), ix.query_rows()).count() == 0
    assert ix.search(frame(spark, [(1, [0.5])]), ix.query_rows()).count() == 0
    alone = ix.search(frame(spark, [(20, [0.5])]), ix.query_rows())
    assert alone.count() == 0 and alone.columns == ["query_id", "rank", "vec_id", "score"]


def test_query_against_sql(spark):
    got = E.queries()["op11_impact_ordered_topk"](spark, SF001)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF001}/embeddings.parquet')")
    want = con.sql(E.oracle_sql()["op11_impact_ordered_topk"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert got.select(F.max("rank")).first()[0] == 20
