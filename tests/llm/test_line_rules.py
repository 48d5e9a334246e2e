import random
import re
from collections import Counter

from conftest import SF01

from tunekiln.llm import line_rules, texts


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_base_measures_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF01}/documents.parquet").select("text").collect()
    rng = random.Random(2)
    made = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 60))) + "\n" * rng.randrange(3) for _ in range(300)]
    model = {"emit": line_rules.np.zeros((len(line_rules.FEATURES), 2)), "trans": line_rules.np.zeros((2, 2))}
    for t in [r["text"] for r in rows] + made + [None, "", "é x \n\x0b a"]:
        assert line_rules.measure(t, model)[:5] == brute(t)


def test_hash_clash_is_counted_by_windows(monkeypatch):
    monkeypatch.setattr(texts, "_MIX", [texts.np.uint64(0)] * 5)  # every window gets one hash
    words = "a b c d e f g a b c d e z".encode().split()
    assert texts.repeated_words(words) == 10


def test_chain_labels_follow_the_rules():
    good = [f"The reason number {i} for this is plain enough to most people who live here." for i in "abcdefgh"]
    bad = ["### $$$ &&& ***", "LOUD WORDS ALL OVER THE PLACE", "spam spam spam spam spam spam spam spam"]
    docs = [[good[i % 7], b, "Short one.", good[i % 7 + 1]] for b in bad for i in range(30)]
    samples = [(x, line_rules.seed_labels(x)) for x in (line_rules.line_features([s.encode() for s in d]) for d in docs)]
    assert samples[0][1].tolist() == [1, 0, -1, 1]
    model = line_rules.train(samples)
    for b in bad:
        assert line_rules.decode(model, line_rules.line_features([x.encode() for x in (good[0], b, good[1])])) == [1, 0, 1]
    assert line_rules.decode(model, line_rules.line_features([x.encode() for x in (good[0], "Short one.", good[1])])) == [1, 1, 1]


def test_edges(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    got = line_rules.judge(docs).collect()
    assert len(got) == len(edge_rows)
    by_id = {r["doc_id"]: r for r in got}
    assert not by_id[3]["kept"] and by_id[3]["base_failed"] and by_id[3]["n_words"] == 0
    assert by_id[1]["kept"] and by_id[2]["kept"] and by_id[None]["kept"]
    kept = line_rules.keep_documents(docs)
    assert kept.schema == docs.schema and kept.count() == sum(r["kept"] for r in got)
    assert line_rules.labelled_lines(docs).filter("doc_id = 1").count() == 1


def test_empty_table(make_docs):
    assert line_rules.judge(make_docs([])).count() == 0
    assert line_rules.keep_documents(make_docs([])).count() == 0


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    j = line_rules.judge(docs).join(labels, "doc_id").filter("not base_failed")
    assert j.filter("quality = 1 and not kept").count() == 0
    assert j.filter("quality = 0 and not kept").count() > 0


def all_labellings(model, x, allowed=None):
    """(score, labels) of every labelling of a short text."""
    s = x @ model["emit"]
    out = []
    for n in range(2 ** len(x)):
        y = [n >> i & 1 for i in range(len(x))]
        if allowed is None or all(a < 0 or a == b for a, b in zip(allowed, y)):
            out.append((sum(s[i, v] for i, v in enumerate(y)) + sum(model["trans"][a, b] for a, b in zip(y, y[1:])), y))
    return out


def test_viterbi_against_all_labellings():
    rng = line_rules.np.random.default_rng(1)
    for _ in range(60):
        model = {"emit": rng.normal(size=(13, 2)), "trans": rng.normal(size=(2, 2))}
        x = rng.random((rng.integers(1, 9), 13))
        best = max(all_labellings(model, x))[0]
        y = line_rules.decode(model, x)
        assert abs(next(s for s, z in all_labellings(model, x) if z == y) - best) < 1e-9


def test_training_climbs_the_likelihood_of_all_labellings():
    """Forward-backward gradients, checked through the likelihood summed over all labellings of short texts."""
    rng = line_rules.np.random.default_rng(2)
    samples = []
    for _ in range(12):
        x = rng.random((int(rng.integers(1, 7)), 13))
        samples.append((x, rng.integers(-1, 2, len(x))))
    lse = line_rules.np.logaddexp.reduce

    def likelihood(model):
        return sum(lse([s for s, _ in all_labellings(model, x, y)]) - lse([s for s, _ in all_labellings(model, x)]) for x, y in samples)

    levels = [likelihood(line_rules.train(samples, steps=n)) for n in (0, 5, 40)]
    assert levels[0] < levels[1] < levels[2]


def test_the_training_sample_has_long_texts_and_each_text_once(make_docs):
    long = "\n".join(f"line {i} of a very long text that has many lines" for i in range(9000))
    docs = make_docs([(1, "one line here", None, None, None)] * 500 + [(2, long, None, None, None), (3, None, None, None, None), (4, "", None, None, None)])
    blocks = [len(r["block"]) // 104 for r in line_rules.training_blocks(docs, 10 ** 6).collect()]
    assert sum(blocks) == 9001 and max(blocks) == line_rules.BLOCK_LINES and blocks.count(1) == 1
    thinned = line_rules.training_blocks(docs, 10 ** 6, 2000).collect()
    assert 1000 < sum(len(r["block"]) // 104 for r in thinned) < 3500
    a, b = line_rules.fit(docs, 10 ** 6, 2000), line_rules.fit(docs.repartition(5), 10 ** 6, 2000)
    assert (a["emit"] == b["emit"]).all() and (a["trans"] == b["trans"]).all()
