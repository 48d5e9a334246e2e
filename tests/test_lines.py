"""File line numbering across several files and splits against Python enumerate."""
import os
import tempfile

from tunekiln.sources.lines import number_rows, read_lines


def test_read_lines_numbering(spark):
    d = tempfile.mkdtemp(prefix="run-lines-", dir="/tmp")
    expect = {}
    for f in range(3):
        lines = []
        for i in range(2500):
            lines.append("" if i % 7 == 3 else ("   " if i % 11 == 5 else f'{{"f": {f}, "i": {i}}}'))
        p = os.path.join(d, f"part{f}.jsonl")
        with open(p, "w") as fh:
            fh.write("\n".join(lines) + "\n")
        nb = 0
        for ln, l in enumerate(lines, 1):
            if l.strip():
                nb += 1
                expect[(f, ln)] = nb
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = read_lines(spark, d).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == len(expect)
    for r in rows:
        f = int(r.slice.rsplit("part", 1)[1][0])
        assert expect[(f, r.line_no)] == r.nb_no
        assert str(r.line_no - 1) in r.raw or r.raw.strip() == ""


def test_number_rows_hot_group(spark):
    # one group holds most rows; numbering must still be 1..n per group
    df = spark.range(0, 20000).selectExpr("id", "CASE WHEN id % 10 < 8 THEN 'hot' ELSE CAST(id % 10 AS STRING) END AS g")
    out = number_rows(df, "id", by=["g"], out="rn", buckets=9)
    got = {(r.g, r.id): r.rn for r in out.collect()}
    exp = {}
    for g in {v[0] for v in got}:
        ids = sorted(i for (gg, i) in got if gg == g)
        for k, i in enumerate(ids, 1):
            exp[(g, i)] = k
    assert got == exp


def test_pair_turns_with_gaps(spark):
    from tunekiln.sources.fixtures import pair_turns
    rows = [(1, 0, "system", "s"), (1, 5, "user", "u1"), (1, 9, "assistant", "a1"), (1, 10, "assistant", "a2"),
            (1, 40, "user", "u2"), (1, 41, "assistant", "a3"), (2, 3, "assistant", "x"), (2, 7, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.turn, r.instruction, r.output) for r in pair_turns(df).collect())
    assert got == [(1, 9, "u1", "a1"), (1, 41, "u2", "a3")]


def test_number_rows_property(spark):
    from hypothesis import given, settings, strategies as st
    from pyspark.sql import functions as F

    @settings(max_examples=12, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 5000)), min_size=1, max_size=300,
                    unique_by=lambda t: t), st.integers(1, 6))
    def check(rows, buckets):
        df = spark.createDataFrame(rows, "g string, k long")
        got = {(r.g, r.k): r.n for r in number_rows(df, "k", by=["g"], out="n", buckets=buckets).collect()}
        exp = {}
        for g in {x[0] for x in rows}:
            for i, k in enumerate(sorted(k for gg, k in rows if gg == g), 1):
                exp[(g, k)] = i
        assert got == exp
    check()


def test_number_rows_sparse_and_text_ids(spark):
    """Sparse ids, text ids and no group: a hot run spreads over the ranges, none of which is large."""
    import pyspark.sql.functions as F
    from tunekiln.sources import lines
    df = spark.range(0, 5000).select((F.col("id") * F.col("id") * F.lit(1_000_003)).alias("k"),
                                     F.concat(F.lit("doc-"), F.lpad((F.col("id") * 7).cast("string"), 9, "0")).alias("t"))
    for c in ("k", "t"):
        got = [r[c] for r in number_rows(df, c, out="n").orderBy("n").collect()]
        assert got == sorted(got) and len(got) == 5000
        cuts = lines._cuts(df, F.col(c), 16)
        sizes = df.groupBy(lines._range_of(F.col(c), cuts, 0, len(cuts)).alias("b")).count().collect()
        assert len(sizes) == 16 and max(r["count"] for r in sizes) < 1500
    plan = number_rows(df, "t", out="n")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_b" in plan


def test_loss_spikes_over_block_borders(spark, monkeypatch):
    from tunekiln.operators import logs
    monkeypatch.setattr(logs, "SPIKE_BLOCK", 7)
    rows = [(r, i * 3, "train_loss" if i % 4 else "eval_loss", float((i * 37 + r) % 11 + (50 if i % 13 == 0 else 1))) for r in (1, 2) for i in range(120)]
    df = spark.createDataFrame(rows, "run_id long, step long, metric string, value double")
    want = []
    for run in (1, 2):
        tr = [(s, v) for r, s, m, v in rows if r == run and m == "train_loss"]
        for i, (s, v) in enumerate(tr):
            prev = [x for _, x in tr[max(0, i - 5):i]]
            if prev and v > 2.0 * sum(prev) / len(prev):
                want.append((run, s, v, round(sum(prev) / len(prev), 9), len(prev)))
    got = sorted((r.run_id, r.step, r.value, round(r.prev_mean, 9), r.prev_n) for r in logs.loss_spikes(df).collect())
    assert got == sorted(want) and len(got) > 5
