import itertools
import random

import pytest

from tunekiln.llm import mixing


def water(sizes, weights, cap=3):
    """Targets by resharing the excess until none is above its cap."""
    total, fixed = float(sum(sizes)), {}
    while True:
        live = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        share = {i: left * weights[i] / sum(weights[j] for j in live) for i in live}
        over = [i for i in live if share[i] > cap * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: float(cap * sizes[i]) for i in over}


def test_targets_are_those_of_resharing(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 12):
        sizes = [rng.choice([0, 1, 5, 100, 10_000]) + rng.randrange(50) + (i == 0) for i in range(n)]
        names = sorted(f"s{i:02d}" for i in range(n - 1)) + [None]
        df = spark.createDataFrame(list(zip(names, sizes)), "source string, size bigint")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = water(sizes, [(5, 2, 1)[i % 3] for i in range(n)])
        assert [got[s] for s in names] == pytest.approx(want, rel=1e-9)


def test_counts_come_nearest_from_below():
    rng = random.Random(5)
    for _ in range(60):
        sizes = rng.sample(range(2, 40), 4)
        counts = [rng.randrange(0, 4) for _ in sizes]
        budget = rng.randrange(0, 160)
        took = mixing.fit_counts(sizes, counts, budget)
        assert all(0 <= k <= n for k, n in zip(took, counts))
        reach = {sum(s * k for s, k in zip(sizes, ks)) for ks in itertools.product(*[range(n + 1) for n in counts])}
        assert sum(s * k for s, k in zip(sizes, took)) == max(r for r in reach if r <= budget)
    assert mixing.fit_counts([3, 5], [10, 10], 41) and sum(s * k for s, k in zip([3, 5], mixing.fit_counts([3, 5], [10, 10], 41))) == 41
    big = mixing.fit_counts([7, 11, 5000], [10**6, 10**6, 10**4], 30_000_001)
    assert 7 * big[0] + 11 * big[1] + 5000 * big[2] == 30_000_001 and min(big) > 1000
    assert mixing.fit_counts([7], [2], 14) == [2] and mixing.fit_counts([7], [2], 13) == [1]


def test_edges_and_reruns(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    got = sorted(mixing.mix(docs).collect(), key=key)
    assert got == sorted(mixing.mix(docs.repartition(5)).collect(), key=key)
    assert len(got) == len(edge_rows)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
    assert {r["size"] for r in got if r["doc_id"] in (3, 4, 5, 11)} == {0}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


def test_words_come_near_the_target(make_docs):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randrange(1, 200)), "en", rng.choice(["a"] * 6 + ["b", "c", "d"]), 0) for i in range(3000)]
    got = mixing.mix(make_docs(rows)).groupBy("source", "target").agg({"taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] - r["target"]) <= 1 for r in got)


def test_empty_table(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    assert mixing.mixed_documents(make_docs([])).count() == 0


def test_long_documents_are_traded():
    assert mixing.fit_counts([17000, 20000], [10, 10], 51000) == [3, 0]
    rng = random.Random(5)
    for _ in range(20):
        sizes = rng.sample(range(9000, 30000, 500), 6)
        counts = [rng.randrange(5, 30) for _ in sizes]
        budget = rng.randrange(40_000, sum(s * n for s, n in zip(sizes, counts)))
        can = 1  # all sums, in steps of 500
        for s, n in zip(sizes, counts):
            for _ in range(n):
                can |= can << s // 500
        best = max(b for b in range(budget // 500 + 1) if can >> b & 1) * 500
        took = mixing.fit_counts(sizes, counts, budget)
        assert all(0 <= k <= n for k, n in zip(took, counts))
        assert sum(s * k for s, k in zip(sizes, took)) == best


def test_lengths_that_stand_once_are_taken_in_proportion():
    sizes = list(range(100, 2100))
    took = mixing.fit_counts(sizes, [1] * len(sizes), sum(sizes) // 2)
    assert sum(s * k for s, k in zip(sizes, took)) == sum(sizes) // 2 and max(took) == 1
    assert 400 < sum(took[:1000]) < 600
