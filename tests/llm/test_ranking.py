import numpy as np
from conftest import SF01
from pyspark.sql import functions as F

from tunekiln.llm import ranking


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    rows = ranking.rank(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_pairs_give_the_order_of_the_utility():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    true = x @ np.array([2.0, -1.0, 0.5, 0.0, 0.0])
    y = (true + rng.normal(scale=0.1, size=600) > np.quantile(true, 0.3)).astype(int)
    model = ranking.fit(x, y)
    u = ranking.utility_to_score(model, x)
    assert ((u >= 0.3) == (y == 1)).mean() > 0.95
    assert abs(model["quantile"] - (y == 0).mean()) < 0.05


def test_edges(make_docs, edge_rows, spark):
    docs = make_docs(edge_rows)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (9, 0, 1), (None, 1, 0), (4, None, None), (777, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = ranking.rank(docs, labels).collect()
    assert len(rows) == len(edge_rows) and all(r["score"] is not None and r["held_out"] is not None for r in rows)
    none = ranking.rank(docs, labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5} and {r["predicted"] for r in none} == {1}
    assert ranking.rank(make_docs([]), labels).count() == 0


def test_every_labelled_document_trains_and_stands_in_pairs(spark):
    docs = spark.range(24_000).selectExpr("id as doc_id", "concat('a short text of words ', id) as text")
    labels = spark.range(24_000).selectExpr("id as doc_id", "cast(id % 8 > 0 as int) as quality")
    train = ranking.land(ranking.numbered(ranking.training_rows(ranking.features(docs), labels)), "test-training")
    numbers = train.groupBy("y").agg(F.count("n"), F.countDistinct("n"), F.min("n"), F.max("n"))
    assert {tuple(r) for r in numbers.collect()} == {(1, 21_000, 21_000, 0, 20_999), (0, 3_000, 3_000, 0, 2_999)}
    pairs = ranking.preference_pairs(train, 21_000, 3_000)
    row = pairs.selectExpr("count(*) c", "count(distinct n) a", "count(distinct slot) b", "count(distinct n, slot) d").first()
    assert tuple(row) == (84_000, 21_000, 3_000, 84_000)


def test_pairs_of_a_very_small_class(spark):
    x = [float(i) for i in range(ranking.N_FEATURES)]
    train = spark.range(2_003).selectExpr("id as doc_id", "cast(id >= 3 as int) as y", "if(id < 3, id, id - 3) as n").withColumn(
        "x", F.array(*[F.lit(v) + F.col("y") for v in x]))
    for good, bad, table in ((2_000, 3, train), (3, 2_000, train.withColumn("y", 1 - F.col("y")))):
        pairs = ranking.preference_pairs(table, good, bad, least=1)
        assert pairs.count() == pairs.select("n", "slot").distinct().count() == 3 * 2_000
        assert {tuple(set(r["d"])) for r in pairs.collect()} == {(1.0 if good > bad else -1.0,)}


def test_different_texts_of_one_id_all_train(make_docs, spark):
    docs = make_docs([(1, "one two three", None, None, None), (1, "four | five !! six", None, None, None), (1, "one two three", None, None, None)])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert ranking.training_rows(ranking.features(docs), labels).count() == 2


def test_cut_of_bins_is_the_cut_of_all_rows():
    rng = np.random.default_rng(1)
    y = (rng.random(3_000) < 0.7).astype(int)
    u = rng.normal(size=3_000).round(2) + 3 * y
    share = (y == 0).mean()
    grid = np.unique(np.concatenate([np.linspace(0, 1, 401), [share]]))
    right = [((u[y == 1] >= c).mean() + (u[y == 0] < c).mean()) / 2 for c in np.quantile(u, grid)]
    best = max(range(len(grid)), key=lambda i: (round(right[i], 6), -abs(grid[i] - share)))
    values, at, n = np.unique(u, return_inverse=True, return_counts=True)
    cut, quantile = ranking.choose_cut(n, np.bincount(at, weights=y), values, values)
    assert quantile == grid[best] and abs(cut - np.quantile(u, quantile)) < 1e-9
    # bins of several values: the cut is one of theirs, at most a bin away
    wide = np.add.reduceat(n, range(0, len(n), 3)), np.add.reduceat(np.bincount(at, weights=y), range(0, len(n), 3)), values[::3], np.append(values[2::3], values[-1])[:-(-len(n) // 3)]
    cut, quantile = ranking.choose_cut(*wide)
    assert abs(cut - np.quantile(u, quantile)) <= (wide[3] - wide[2]).max() + 1e-9
