import random
import re

import pytest

from tunekiln.llm import components, near_join


def shingles(t, size):
    w = tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    return frozenset(w[i:i + size] for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([w] if w else [])


def brute(rows, percent, size):
    sets = [(d, shingles(t, size)) for d, t in rows]
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b) or sets[i][0] == sets[j][0]:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(s), least[top(i)]) for i, (d, s) in enumerate(sets))


def fixture(seed):
    """Texts with exact copies, near copies at all distances, chains, and short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 2, 3, 4, 8, 11, 20, 60, 150, 400]))]
        for _ in range(rng.randrange(1, 6)):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t))
            if rng.random() < 0.3:
                rows.append(" ".join(t).upper())
            if rng.random() < 0.3:  # a chain: each differs a little from the one before
                base = t
    template = [word() for _ in range(80)]
    for _ in range(40):  # many texts that share much, few of them linked
        t = list(template)
        for _ in range(rng.randrange(0, 7)):
            t[rng.randrange(len(t))] = word()
        rows.append(" ".join(t))
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(1000, None), (1001, ""), (1002, "\n")]


@pytest.mark.parametrize("percent,size,rounds,tile", [(90, 3, 2, 1000), (80, 5, 1, 7), (90, 3, 0, 5)])
def test_components_against_brute_force(make_docs, monkeypatch, percent, size, rounds, tile):
    monkeypatch.setattr(near_join, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(near_join, "TILE", tile)
    if percent == 80:  # every other key counts as hot
        monkeypatch.setattr(near_join, "SAMPLE", 2)
        monkeypatch.setattr(near_join, "HOT", 2)
    rows = fixture(percent + rounds)
    got = near_join.join(make_docs([(d, t, None, None, None) for d, t in rows]), percent, size).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, percent, size)


@pytest.mark.parametrize("percent,size,pairs", [(80, 5, 200), (90, 3, 2)])
def test_all_links_against_brute_force(make_docs, monkeypatch, percent, size, pairs):
    monkeypatch.setattr(near_join, "PAIRS", pairs)
    monkeypatch.setattr(near_join, "HOT_ROWS", 5)
    rows = [(d, t) for d, t in fixture(7)] + [(2000 + i, " ".join(f"s{k}" for k in range(i % 3, i % 3 + 5 + i // 3))) for i in range(30)]
    links, members = near_join.links(make_docs([(d, t, None, None, None) for d, t in rows]), percent, size)
    sets = {d: shingles(t, size) for d, t in rows}
    least = {}
    for d in sorted(sets):
        least.setdefault(sets[d], d)
    assert sorted(map(tuple, members.collect())) == sorted((d, len(s), least[s] if s else None) for d, s in sets.items())
    reps = [(d, s) for s, d in least.items() if s]
    want = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(reps) for b, y in reps[:i] if 100 * len(x & y) >= percent * len(x | y)}
    assert sorted(map(tuple, links.collect())) == sorted(want) and len(want) > 20


def test_sets_on_the_fall_back_keep_their_empty_blocks():
    """Two linked sets always share a block to join on, and few sets join on empty blocks."""
    rng = random.Random(4)
    fall_back = 0
    for percent in (80, 90):
        for _ in range(1500):
            n = rng.choice([2, 4, 5, 6, 8, 9, 12, 20, 45, 200])
            a = near_join.np.unique(near_join.np.array([rng.getrandbits(64) for _ in range(n)], dtype="u8"))
            b = list(a)
            for _ in range(rng.randrange(0, 1 + near_join.most_different(n, n, percent))):
                b[rng.randrange(len(b))] = near_join.np.uint64(rng.getrandbits(64))
            b = near_join.np.unique(near_join.np.array(b[:len(b) - rng.randrange(0, 2)], dtype="u8"))
            if not near_join.linked(a, b, percent):
                continue
            most = near_join.most_different(n + 2, n + 2, percent)
            blocks = near_join.ceil(near_join.SPARE * (most + 1))
            x, y = (near_join.wide_sketch(s, blocks, most) for s in (a, b))
            assert any(u is not None and u == v for u, v in zip(x, y))
            fall_back += None not in x and 0 in x
    assert fall_back >= 5


def test_bands_reach_all_partners():
    for percent in (80, 90):
        bounds = near_join._bounds(percent, 100_000)
        band = lambda n: next(i for i in range(len(bounds)) if bounds[i + 1] > n)
        for n in list(range(1, 400)) + [999, 5000, 77_777]:
            assert band(100 * n // percent) - band(n) <= 1


def test_sketch_never_exceeds_the_difference():
    rng = random.Random(9)
    for _ in range(50):
        a = near_join.np.unique(near_join.np.array([rng.getrandbits(64) for _ in range(80)], dtype="u8"))
        b = near_join.np.unique(near_join.np.concatenate([a[:rng.randrange(80)], near_join.np.array([rng.getrandbits(64) for _ in range(20)], dtype="u8")]))
        far = near_join.np.bitwise_count((near_join.sketch(a, 9) ^ near_join.sketch(b, 9)).view("u8")).sum()
        assert far <= len(near_join.np.setxor1d(a, b))


def test_edges(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    got = near_join.join(docs).collect()
    assert len(got) == len(edge_rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["component_id"] == 1 and by_id[3]["component_id"] == 3 and by_id[3]["n_shingles"] == 0
    kept = near_join.keep_one(docs)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and 2 not in ids and ids.count(1) == 1 and {3, 4, 5, 11} <= set(ids)
    assert near_join.join(make_docs([])).count() == 0 and near_join.keep_one(make_docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(0)
    chain = [(i, i + 1) for i in range(200)]
    star = [(500, 500 + i) for i in range(1, 300)]
    ring = [(900 + i, 900 + (i + 1) % 50) for i in range(50)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in chain + star + ring + [(7, 7)]]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{500 + i: 500 for i in range(1, 300)}, **{900 + i: 900 for i in range(1, 50)}}


def test_keep_one_by_rows_not_by_ids(make_docs):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    nameless = [(None, text(1)), (None, text(1)), (None, text(1) + " end"), (None, text(2)), (None, text(6)), (None, ""), (None, ""), (None, None)]
    named = [(3, text(6)), (4, text(7)), (9, text(7) + " end"), (8, "")]
    repeated = [(5, text(3)), (5, text(4)), (7, text(5)), (7, text(5)), (8, "")]

    def kept(rows):
        out = near_join.keep_one(make_docs([(d, t, None, None, None) for d, t in rows]))
        assert "_near_key" not in out.columns
        return sorted(((r["doc_id"], (r["text"] or "").removesuffix(" end")) for r in out.collect()), key=repr)

    want = [(None, text(1)), (None, text(2)), (None, ""), (None, ""), (None, ""), (3, text(6)), (4, text(7)), (8, "")]
    assert kept(nameless + named) == sorted(want, key=repr)
    # a repeated id elsewhere changes nothing for them, and its different texts both stay
    assert kept(nameless + named + repeated) == sorted(want + [(5, text(3)), (5, text(4)), (7, text(5))], key=repr)
    assert kept(named + repeated[:2]) == sorted([(3, text(6)), (4, text(7)), (8, ""), (5, text(3)), (5, text(4))], key=repr)


def test_small_lots_reach_the_workers(spark, make_docs):
    """Rows go to the workers in batches of some MB, the join's texts in lots of LOT, and the words are given back."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    from tunekiln.llm.common import per_text
    from tunekiln.session import prepare

    prepare(spark)
    docs = make_docs([(i, f"t{i} " + "a word " * 1500, "en", "a", 1) for i in range(2000)], extra=False).coalesce(1)

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "b": [batch.nbytes]})

    sent = docs.mapInArrow(size, "n bigint, b bigint").collect()
    assert sum(r["n"] for r in sent) == 2000 and max(r["b"] for r in sent) < 5 << 20

    def lots(texts):
        near_join.shingle_set("some words")
        return {"lot": [sum(map(len, texts))] * len(texts), "known": [len(near_join._HASH)] * len(texts)}

    made = lambda: per_text(docs, [F.col("doc_id")], lots, "lot bigint, known bigint", max_bytes=near_join.LOT, done=near_join._rest)
    rows = made().collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(2000)) and max(r["lot"] for r in rows) <= near_join.LOT
    assert {r["known"] for r in rows} == {2}
    near_join.shingle_set("other words here")
    near_join._rest()
    assert not near_join._HASH
