"""Language identification with labelled spans of mixed-language text.

Words are runs of letters. Unicode script ranges narrow a word's candidates to the languages whose training
text uses its script. Hashed character bigrams and trigrams (with word borders) give each candidate a
log-probability, clipped so that no single word decides alone; a Viterbi pass with a switching penalty then
labels the words of a text, and runs of one label are its spans. A text's language is the label with the
most letters, its score their share of all letters.

Training reads a bounded sample: about ``TRAIN_DOCS`` documents of each language, chosen by a hash of the
id (the fraction follows from the language's count). What reaches the driver is the count of each language
and at most languages x 2 x ``BINS`` n-gram counts; that model is what executors get. Scoring is row by row
over whole texts, cut into pieces of a bounded number of letters for the arrays.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and no spans; words in a
script that no learned language uses are neutral; ties go to the language first in code point order;
without any training row everything is ``und``; repeated rows are judged alike; an empty table gives an
empty result; lang, source, doc_id and other columns never enter a prediction.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, light_batches, per_text

TRAIN_DOCS = 3000
BINS = 1 << 16
PENALTY = 12.0
CLIP = 6.0
MIN_SCRIPT = 0.01
PIECE = 1 << 20
# Unicode ranges of scripts (fixed values); letters outside them belong to script 0
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)], "Hebrew": [(0x590, 0x5FF)], "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)], "Bengali": [(0x980, 0x9FF)], "Gurmukhi": [(0xA00, 0xA7F)], "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)], "Telugu": [(0xC00, 0xC7F)], "Kannada": [(0xC80, 0xCFF)], "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)], "Thai": [(0xE00, 0xE7F)], "Lao": [(0xE80, 0xEFF)], "Tibetan": [(0xF00, 0xFFF)], "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)], "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Ethiopic": [(0x1200, 0x139F)], "Khmer": [(0x1780, 0x17FF)], "Hiragana": [(0x3040, 0x309F)], "Katakana": [(0x30A0, 0x30FF), (0x31F0, 0x31FF)],
    "Han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter (0: not a letter) and the script."""
    lower = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 else i
    script = np.zeros(0x110000, dtype=np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            script[a:b + 1] = k + 1
    return lower, script


def _pieces(text: str, limit: int):
    """Parts of at most ``limit`` code points, cut after a blank where there is one."""
    a = 0
    while len(text) - a > limit:
        b = text.rfind(" ", a, a + limit) + 1
        b = b if b > a else a + limit
        yield a, text[a:b]
        a = b
    yield a, text[a:]


def letters(text: str):
    """(bigram bin, trigram bin, script) of each letter; first letter, start and end of each word."""
    lower, scripts = _tables()
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    c = np.zeros(len(raw) + 2, dtype=np.uint64)
    c[1:-1] = lower[raw]
    at = np.flatnonzero(c)
    if not len(at):
        return None
    first = c[at - 1] == 0
    left, mid, right = c[at - 1], c[at], c[at + 1]
    two = (left * np.uint64(0x9E3779B97F4A7C15) ^ mid * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(7)
    three = two ^ (right + np.uint64(1)) * np.uint64(0x165667B19E3779F9)
    mix = lambda h: ((h ^ h >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) % np.uint64(BINS)
    return (mix(two).astype(np.int64), mix(three).astype(np.int64), scripts[raw[at - 1]], np.flatnonzero(first),
            at[first] - 1, at[c[at + 1] == 0])


def word_scores(text: str, model: dict):
    """(W x L scores, starts, ends) of the words of a text."""
    langs = len(model["langs"])
    scores, starts, ends = [], [], []
    for a, piece in _pieces(text, max(1 << 14, PIECE // langs)):
        found = letters(piece)
        if found is None:
            continue
        two, three, script, first, s, e = found
        x = np.add.reduceat(model["two"][two] + model["three"][three], first, axis=0)
        fits = model["scripts"][script[first]]
        any_fit = fits.any(axis=1, keepdims=True)
        x = np.where(any_fit & ~fits, -np.inf, x)
        x = np.maximum(x - x.max(axis=1, keepdims=True), -CLIP)
        scores.append(np.where(any_fit, x, 0.0))
        starts.append(s + a)
        ends.append(e + a)
    if not scores:
        return np.zeros((0, langs)), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(scores), np.concatenate(starts), np.concatenate(ends)


def viterbi(texts: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
    """Best label sequence of each word-score matrix; position t of all texts is computed together.

    A text whose words' best scores exceed its best single language by no more than one switch costs needs
    no pass: the single language is then a best sequence."""
    out: list[np.ndarray] = [np.zeros(len(x), dtype=np.int64) for x in texts]
    todo = []
    for i, x in enumerate(texts):
        if len(x):
            sums = x.sum(axis=0)
            best = int(sums.argmax())
            if x.max(axis=1).sum() - sums[best] <= penalty:
                out[i][:] = best
            else:
                todo.append(i)
    todo.sort(key=lambda i: -len(texts[i]))
    if not todo:
        return out
    x = np.concatenate([texts[i] for i in todo])
    n = np.array([len(texts[i]) for i in todo])
    base = np.concatenate([[0], np.cumsum(n)[:-1]])
    alive = np.searchsorted(-n, -np.arange(n[0]), side="left")  # texts longer than t
    switched = np.zeros(x.shape, dtype=bool)
    source = np.zeros(len(x), dtype=np.int64)
    v = x[base].copy()
    for t in range(1, n[0]):
        k = alive[t]
        rows = base[:k] + t
        live = v[:k]
        arg = live.argmax(axis=1)
        top = live[np.arange(k), arg][:, None] - penalty
        switched[rows] = live < top
        source[rows] = arg
        v[:k] = np.maximum(live, top) + x[rows]
    labels = np.zeros(len(x), dtype=np.int64)
    state = v.argmax(axis=1)
    for t in range(n[0] - 1, -1, -1):
        k = alive[t]
        rows = base[:k] + t
        labels[rows] = state[:k]
        if t:
            state[:k] = np.where(switched[rows, state[:k]], source[rows], state[:k])
    for i, b, m in zip(todo, base, n):
        out[i] = labels[b:b + m]
    return out


def identify_texts(texts: list[str | None], model: dict | None) -> list[tuple[str, float, list[dict]]]:
    """(language, score, spans) of each text."""
    if model is None or not model["langs"]:
        return [("und", 0.0, [])] * len(texts)
    words = [word_scores(t or "", model) for t in texts]
    out = []
    for (x, starts, ends), y in zip(words, viterbi([w[0] for w in words])):
        if not len(x):
            out.append(("und", 0.0, []))
            continue
        share = np.bincount(y, weights=ends - starts, minlength=len(model["langs"]))
        best = int(share.argmax())
        cut = np.flatnonzero(np.diff(y)) + 1
        a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(y)]]) - 1
        spans = [{"start": int(starts[i]), "end": int(ends[j]), "lang": model["langs"][y[i]]} for i, j in zip(a, b)]
        out.append((model["langs"][best], float(share[best] / share.sum()), spans))
    return out


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict | None:
    """Model from the rows of ``docs`` (doc_id, text, lang) that have a lang and a text."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(
        "lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, train_docs / counts[lang])))])
    # a hash of the id in [0, 1) against the language's fraction
    chance = F.pmod(F.xxhash64(F.lit(1), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(F.coalesce(chance, F.lit(0.0)) < share[F.col("lang")]).select("lang", "text")
    scripts = len(SCRIPTS) + 1

    def count(batches):
        total = {}
        for batch in light_batches(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held = total.setdefault(lang, np.zeros(2 * BINS + scripts, dtype=np.int64))
                for _, piece in _pieces(text, PIECE):
                    found = letters(piece)
                    if found is not None:
                        held += np.bincount(np.concatenate([found[0], BINS + found[1], 2 * BINS + found[2].astype(np.int64)]), minlength=len(held))
        for lang, held in total.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(held[at], pa.int64())],
                                             names=["lang", "bin", "n"])

    found = sample.mapInArrow(count, "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros((2 * BINS + scripts, len(langs)))
    held[found["bin"], found["lang"].map({v: i for i, v in enumerate(langs)})] = found["n"]
    learn = lambda h: np.log((h + 0.05) / (h.sum(axis=0) + 0.05 * len(h))).astype(np.float32)
    script = held[2 * BINS:]
    return {"langs": langs, "two": 0.5 * learn(held[:BINS]), "three": learn(held[BINS:2 * BINS]),
            "scripts": script >= np.maximum(1, MIN_SCRIPT * script.sum(axis=0))}


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score, spans): spans are (start, end, lang) in code points, end exclusive."""
    def rows(texts):
        found = identify_texts(texts, model)
        return {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "spans": [f[2] for f in found]}

    return per_text(docs, [F.col("doc_id")], rows, "lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")


def held_out_predictions(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Predictions of all documents by a model of those outside the held-out fold (null ids are in neither)."""
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs.filter(fold(F.col("doc_id"), 5) != 0), train_docs)
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score",
                                        F.size("spans").cast("bigint").alias("n_spans"), "spans")
