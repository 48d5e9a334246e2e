import itertools

import numpy as np
from conftest import SF01

from tunekiln.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = language.held_out_predictions(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.98


def best_sequence(x, penalty):
    return max(sum(x[t, y] for t, y in enumerate(ys)) - penalty * sum(a != b for a, b in zip(ys, ys[1:]))
               for ys in itertools.product(range(x.shape[1]), repeat=len(x)))


def test_viterbi_against_all_sequences():
    rng = np.random.default_rng(1)
    texts = [rng.normal(size=(n, 3)) * 3 for n in (1, 2, 5, 7, 7, 0, 4)]
    for x, y in zip(texts, language.viterbi(texts, 2.0)):
        got = x[np.arange(len(y)), y].sum() - 2.0 * (np.diff(y) != 0).sum()
        assert len(y) == len(x) and (not len(x) or abs(got - best_sequence(x, 2.0)) < 1e-9)


def test_mixed_text_and_scripts(make_docs):
    en = ["the weather is rather nice this morning", "people were talking about their houses", "she thinks that nothing was there"]
    de = ["das wetter ist heute morgen wirklich schoen", "die leute sprachen ueber ihre haeuser und gaerten", "ich denke dass nichts davon uebrig ist"]
    ru = ["погода сегодня хорошая"] * 3
    rows = [(i, t, lang, None, None) for i, (t, lang) in enumerate([(t, k) for k, ts in (("en", en), ("de", de), ("ru", ru)) for t in ts for _ in range(5)])]
    model = language.fit(make_docs(rows))
    assert model["langs"] == ["de", "en", "ru"]
    text = " ".join(en) + " " + " ".join(de) + " погода хорошая сегодня"
    (lang, score, spans), = language.identify_texts([text], model)
    assert [s["lang"] for s in spans] == ["en", "de", "ru"] and lang == "de" and 0 < score < 1
    assert text[spans[1]["start"]:].startswith("das wetter") and text[spans[2]["start"]:spans[2]["end"]].startswith("по")
    assert language.identify_texts([None, "", "123 !!"], model) == [("und", 0.0, [])] * 3


def test_edges(make_docs, edge_rows, monkeypatch):
    docs = make_docs(edge_rows)
    monkeypatch.setattr(language, "PIECE", 1 << 16)
    rows = {r["doc_id"]: r for r in language.held_out_predictions(docs).collect()}
    assert rows[3]["lang_pred"] == rows[5]["lang_pred"] == rows[9]["lang_pred"] == "und" and rows[8]["lang_pred"] != "und"
    assert language.held_out_predictions(make_docs([])).count() == 0
    unlabelled = docs.withColumn("lang", docs["lang"].substr(99, 1)).replace("", None, ["lang"])
    assert {r["lang_pred"] for r in language.held_out_predictions(unlabelled).collect()} == {"und"}


def test_pieces_cover_the_text():
    text = "ab cd " * 40 + "x" * 50
    parts = list(language._pieces(text, 16))
    assert "".join(p for _, p in parts) == text and all(text[a:].startswith(p) for a, p in parts)
