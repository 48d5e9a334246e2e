import hashlib
import random
import re

from tunekiln.llm import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w and i is not None else 0):
            wins.setdefault(k, {}).setdefault(tuple(w[s:s + k]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k, by in wins.items():
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) in by:
                    hit |= set(range(s, s + k))
                    ids |= by[tuple(w[s:s + k])]
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def fixture():
    rng = random.Random(4)
    word = lambda: rng.choice(["The", "of", "and", "xé", "Été", "zq%d" % rng.randrange(400), "a1"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 5, 12, 13, 14, 30])))) for i in range(40)]
    items += [(7, "repeated item id with quite different words in it than before so to say here"), (None, "null item words are left alone here"), (90, None), (91, "the the the the the the the the the the the the the the")]
    docs = []
    for d in range(150):
        t = [word() for _ in range(rng.randrange(0, 120))]
        if d % 3 == 0:
            p = words(items[rng.randrange(len(items))][1])
            t[5:5] = p[rng.randrange(3):] if p else []
        docs.append((d, ", ".join(t).upper() if d % 2 else "-".join(t)))
    docs += [(200, None), (201, ""), (0, docs[0][1]), (None, docs[3][1]), (202, "The " * 400), (203, "x " * 30_000 + (items[5][1] or ""))]
    return docs, items


def test_against_brute_force(spark, make_docs, monkeypatch):
    docs, items = fixture()
    d = make_docs([(i, t, None, None, None) for i, t in docs])
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as term", "2 as n", "3 as words")
    want = brute(docs, items)
    assert sorted((tuple(r) for r in decontaminate.contamination(d, b).collect()), key=repr) == want
    kept = decontaminate.keep_documents(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted((r[0] or -1) for r in want if not r[5])
    monkeypatch.setattr(decontaminate, "BLOCK_TERMS", 100)  # several blocks of test terms
    assert sorted((tuple(r) for r in decontaminate.contamination(d, b).collect()), key=repr) == want


def test_proximity_finds_moved_words(spark, make_docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    moved = item.replace("beta", "beta something new")
    d = make_docs([(1, item, None, None, None), (2, moved, None, None, None), (3, "alpha beta only " * 5, None, None, None)])
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert {r["doc_id"] for r in decontaminate.proximity(d, b).collect()} >= {1, 2}
    assert [r["doc_id"] for r in decontaminate.phrases(d, b).collect()] == [1]


def test_empty_tables(spark, make_docs, edge_rows):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(make_docs([]), none).count() == 0
    rows = decontaminate.contamination(make_docs(edge_rows), none).collect()
    assert len(rows) == len(edge_rows) and not any(r["contaminated"] for r in rows)
    assert decontaminate.keep_documents(make_docs(edge_rows), none).count() == len(edge_rows)


def test_no_python_and_no_text_shuffle(spark, make_docs):
    docs, items = fixture()
    d = make_docs([(i, t, None, None, None) for i, t in docs])
    b = spark.createDataFrame(items, "item_id bigint, text string")
    plan = decontaminate.contamination(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
