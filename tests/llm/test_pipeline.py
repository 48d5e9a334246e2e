import corpus_pipeline
from conftest import SF001

from tunekiln.llm import decontaminate, line_rules
from tunekiln.llm.common import land
from .test_decontaminate import brute as contaminated
from .test_near_join import brute as near


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    names = docs.columns
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = land(stage(spark, docs, SF001), "test-stage")
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name != "token records":
            assert out.columns == names
        ids = sorted(r["doc_id"] for r in out.select("doc_id").collect())
        if name == "quality rules":
            model = line_rules.fit(docs)
            want = [d for d, t in rows for n, _, _, _, rep, share, _ in [line_rules.measure(t, model)]
                    if not line_rules.base_failed(n, rep) and share >= line_rules.MIN_CONTENT]
        elif name == "near duplicates":
            want = [d for d, _, c in near(rows, 80, 5) if d == c]
        elif name == "decontamination":
            want = [r[0] for r in contaminated(rows, bench) if not r[5]]
        elif name == "mix":
            want = ids
            words = {d: len((t or "").encode().split()) for d, t in rows}
            total, took = sum(words.values()), sum(words[d] for d in ids)
            assert abs(total - took) <= 0.02 * total + 100 and max(ids.count(d) for d in set(ids)) <= 3
        else:
            want = [d for d, _ in rows]
            starts = sorted((r["start"], r["n_tokens"]) for r in out.collect())
            assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]
        assert ids == sorted(want), name
        kept[name], docs = len(ids), out
    assert decontaminate.WINDOW == 13 and list(kept) == [n for n, _ in corpus_pipeline.STAGES]


def test_stages_on_edge_rows_and_an_empty_table(spark, make_docs, edge_rows):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns, and a table without rows."""
    clean = [(100 + i, f"Document {i} holds {i * 7} plain words that no other document of this small table has in its place. "
              + " ".join(f"word{i}x{k}" for k in range(40)) + ".", "en", "a", 1) for i in range(12)]
    for rows in (edge_rows + clean, []):
        docs = make_docs(rows)
        for name, stage in corpus_pipeline.STAGES:
            out = land(stage(spark, docs, SF001), "test-edge-stage")
            if name != "token records":
                assert out.columns == docs.columns
                kept = {r["doc_id"] for r in out.select("doc_id").collect()}
                assert not rows or name == "mix" or kept >= {r[0] for r in clean}
            docs = out
        starts = sorted((r["start"], r["n_tokens"]) for r in docs.collect())
        assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))] and bool(starts) == bool(rows)
