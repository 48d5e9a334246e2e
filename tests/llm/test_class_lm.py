import math
import zlib
from collections import Counter

import numpy as np
from conftest import SF01
from pyspark.sql import functions as F

from tunekiln.llm import class_lm


def test_exchange_separates_two_alternating_groups():
    rng = np.random.default_rng(0)
    m = 12
    pairs = np.zeros((m + 1, m + 1))
    for _ in range(5000):  # even words are followed by odd ones and the other way round
        a = rng.integers(m)
        b = rng.choice(np.arange(1 - a % 2, m, 2))
        pairs[a, b] += 1
    of = class_lm.exchange(pairs, classes=2, rounds=10)
    assert len(set(of[::2])) == 1 and len(set(of[1::2])) == 1 and of[0] != of[1]


def test_move_out_of_the_start_class_raises_the_likelihood_most():
    rng = np.random.default_rng(1)
    side, other = class_lm.SIDE, class_lm.OTHER
    seq = rng.integers(0, 60, 4000)
    of = np.where(seq < 40, seq % class_lm.CLASSES, other)  # words 40 to 59 start in OTHER
    n = np.zeros((side, side))
    np.add.at(n, (of[:-1], of[1:]), 1)

    def value(cls):
        m = np.zeros((side, side))
        np.add.at(m, (cls[:-1], cls[1:]), 1)
        f = lambda a: (a * np.log(np.maximum(a, 1))).sum()
        return f(m) - f(m.sum(axis=0)) - f(m.sum(axis=1))

    for w in (41, 50, 59):
        left, right = np.zeros((1, side)), np.zeros((1, side))
        for a, b, ca, cb in zip(seq[:-1], seq[1:], of[:-1], of[1:]):
            left[0, ca] += b == w != a
            right[0, cb] += a == w != b
        own = np.array([((seq[:-1] == w) & (seq[1:] == w)).sum()])
        got = class_lm.best_class(n, left, right, own)[0]
        values = [value(np.where(seq == w, k, of)) for k in range(class_lm.CLASSES)]
        assert abs(values[got] - max(values)) < 1e-6


def test_words_beyond_the_head_get_classes_by_their_neighbours(spark, make_docs, monkeypatch):
    monkeypatch.setattr(class_lm, "FLUSH", 20)
    # x words stand where "x" does, y words where "y" does: both as rare, so that counts alone cannot tell them apart
    texts = [f"a x{i} c a x c b y{i} d b y d" for i in range(60)]
    docs = make_docs([(i, t, None, None, None) for i, t in enumerate(texts)])
    classes = {w.encode(): k for k, w in enumerate("abcdxy")}
    rows = class_lm._chunked(docs, F.lit(False))
    near = class_lm._neighbours(rows, classes)
    pairs = np.zeros(class_lm.SIDE ** 2)
    for r in near.filter("word is null").collect():
        pairs[r["pair"]] += r["n"]
    assert pairs.sum() == sum(len(t.split()) + 1 for t in texts)
    got = {bytes(r["word"]): r["class"] for r in class_lm._assign(near.filter("word is not null"), pairs.reshape(class_lm.SIDE, -1)).collect()}
    assert set(got) == {f"{k}{i}".encode() for k in "xy" for i in range(60)}
    assert {got[f"x{i}".encode()] for i in range(60)} == {4} and {got[f"y{i}".encode()] for i in range(60)} == {5}


def check(rows, got, held):
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update((t or "").encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    by_id = dict(rows)
    for r in got:
        words = (by_id[r["doc_id"]] or "").encode().lower().split() + [None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert abs(r["base_score"] - base) <= 1e-7 * max(1, abs(base))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r["score"] < 0 and r["held_out"] == held(r["doc_id"])


def test_base_against_brute_force_and_held_out_perplexity(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "FLUSH", 2000)
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = class_lm.score(docs).collect()
    assert len(got) == len(rows)
    check(rows, got, lambda d: zlib.crc32(str(d).encode()) % 7 == 2)
    held = [r for r in got if r["held_out"]]
    per_token = lambda c: sum(r[c] for r in held) / sum(r["n_tokens"] for r in held)
    assert per_token("score") > per_token("base_score")


def test_probabilities_add_up_to_at_most_one(spark, make_docs):
    rows = [(i, " ".join("abcd"[j % 4] for j in range(i % 5 + 1)), None, None, None) for i in range(40)]
    got = class_lm.score(make_docs(rows + [(100, w, None, None, None) for w in ()])).collect()
    # distinct texts are distinct events of the model
    assert sum({rows[r["doc_id"]][1]: 10 ** r["score"] for r in got}.values()) <= 1


def test_edges(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    got = class_lm.score(docs).collect()
    assert len(got) == len(edge_rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["n_tokens"] == by_id[4]["n_tokens"] == 1 and by_id[None]["held_out"] is False
    from pyspark.sql import functions as F
    none = class_lm.score(docs, held_out=F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in none)
    assert class_lm.score(make_docs([])).count() == 0


def test_neighbours_have_one_row_for_each_word(spark, make_docs, monkeypatch):
    monkeypatch.setattr(class_lm, "FLUSH", 3)
    monkeypatch.setattr(class_lm, "MOST", 20)  # larger counts take several numbers
    docs = make_docs([(i, "a rare rare b", None, None, None) for i in range(70)] + [(100 + i, f"a once{i} b", None, None, None) for i in range(30)]).repartition(5)
    near = class_lm._neighbours(class_lm._chunked(docs, F.lit(False)), {b"a": 0, b"b": 1})

    def total(rows):
        out = Counter()
        for r in rows:
            for x in np.frombuffer(r["near"], "<u4").tolist():
                out[bytes(r["word"]), x >> 24] += x & 0xFFFFFF
        return out

    before, after = near.collect(), class_lm._gather(near).collect()
    assert len([r for r in before if r["word"] == b"rare"]) > 1
    words = [bytes(r["word"]) for r in after if r["word"] is not None]
    assert len(words) == len(set(words)) == 31
    assert total(r for r in after if r["word"]) == total(r for r in before if r["word"])
    assert total(r for r in after if r["word"])[b"rare", 0] == 70
    assert max(x & 0xFFFFFF for r in after if r["word"] for x in np.frombuffer(r["near"], "<u4").tolist()) == 20
    key = lambda r: (r["pair"], r["n"])
    assert sorted(key(r) for r in after if r["word"] is None) == sorted(key(r) for r in before if r["word"] is None)


def test_scratch_tables_go_when_the_next_is_written(spark, make_docs, monkeypatch):
    import os

    from tunekiln import session
    base, written = session.checkpoint_dir(spark).removeprefix("file:"), []

    def land(df, name):
        out = session.land(df, name)
        written.append((name, out, sorted(f.rsplit("-", 1)[0] for f in os.listdir(base) if f not in there), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return out

    there = set(os.listdir(base))
    monkeypatch.setattr(class_lm, "land", land)
    got = class_lm.score(make_docs([(i, f"the cat w{i} sat on m{i % 7}", None, None, None) for i in range(200)]))
    assert got.count() == 200
    assert [w[0] for w in written] == ["lm-words", "lm-neighbours", "lm-classes", "lm-documents"]
    assert written[0][3] == 1  # one shuffle for the sums by chunk and word and for the totals by word
    assert written[3][2] == ["tunekiln-lm-classes", "tunekiln-lm-documents"]
    assert sorted(f.rsplit("-", 1)[0] for f in os.listdir(base) if f not in there) == ["tunekiln-lm-documents"]
