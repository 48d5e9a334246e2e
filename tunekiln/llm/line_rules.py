"""Quality rules with line labels from a linear-chain conditional random field.

Every line of a text is content or boilerplate. A two-state linear-chain CRF scores the label sequence
from features of each line and from the transition between neighbours; Viterbi decoding gives the best
sequence. The share of a text's word characters on content lines decides retention, after the base
rules. The CRF is trained here, on a bounded sample of documents (``TRAIN_DOCS`` and
``TRAIN_LINES``, parameters) of any length whose lines get seed labels from plain rules; the chain then labels lines that the rules leave open by their
neighbours. Scoring is row by row: nothing but the features of the sample's lines leaves the executors.

Defined cases: null, empty and blank texts have no words, fail the base rule and are not kept; an empty
table gives an empty result (zero weights keep every line); repeated rows are judged alike; other columns
of the input are ignored, or passed through by ``keep_documents``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land, light_batches, per_text
from .texts import BLANKS, SYMBOLS, duplicate_lines, repeated_words, without

TRAIN_DOCS = 2000        # documents of the training sample
TRAIN_LINES = 100_000    # lines of the training sample, about (13 numbers each reach the driver)
BLOCK_LINES = 128        # lines of one training sequence at most
MIN_CONTENT = 0.3        # least share of word characters on content lines
MIN_WORDS = 10
UPPERS, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
ENDS = (b".", b"!", b"?", b":", b'"')
PUNCT = b"!\"'(),-./:;?[]_{}~=+\\@^`"
FEATURES = ("bias", "few words", "many words", "symbols", "capitals", "digits", "punctuation", "ends a sentence",
            "equals an earlier line", "one word repeated", "first", "last", "blank")


def line_features(lines: list[bytes]) -> np.ndarray:
    dup = duplicate_lines(lines)
    last = len(lines) - 1
    rows = []
    for i, line in enumerate(lines):
        words = line.split()
        n, size = len(words), max(1, without(line, BLANKS))
        rows.append((
            1.0, n < 4, n >= 8, min(1.0, 4.0 * (len(line) - without(line, SYMBOLS)) / size),
            (len(line) - without(line, UPPERS)) / size, (len(line) - without(line, DIGITS)) / size,
            min(1.0, 4.0 * (len(line) - without(line, PUNCT)) / size), line.rstrip(BLANKS).endswith(ENDS),
            dup[i], 1.0 - len(set(words)) / n if n > 4 else 0.0, i == 0, i == last, n == 0))
    return np.array(rows, dtype=np.float64)


def seed_labels(x: np.ndarray) -> np.ndarray:
    """1 content, 0 boilerplate, -1 open (left to the chain): the plain rules behind the training labels."""
    f = {name: x[:, i] for i, name in enumerate(FEATURES)}
    bad = ((f["symbols"] >= 0.4) | (f["capitals"] > 0.6) | (f["equals an earlier line"] > 0) | (f["one word repeated"] > 0.6)
           | (f["digits"] > 0.5))
    good = (f["many words"] > 0) & (f["symbols"] < 0.1) & (f["capitals"] < 0.3) & (f["one word repeated"] < 0.5)
    return np.where(bad, 0, np.where(good, 1, -1))


def train(samples: list[tuple[np.ndarray, np.ndarray]], steps: int = 40, rate: float = 0.5, decay: float = 1e-3) -> dict:
    """Maximise the likelihood of the seed labels (open lines summed over both) by gradient ascent.

    Forward-backward runs over all sequences at once, position by position, with the labels clamped for
    the numerator and free for the denominator. Returns emission weights and the transition matrix."""
    k = len(FEATURES)
    emit, trans = np.zeros((k, 2)), np.zeros((2, 2))
    samples = sorted((s for s in samples if len(s[0])), key=lambda s: -len(s[0]))
    if not samples:
        return {"emit": emit, "trans": trans}
    lengths = np.array([len(x) for x, _ in samples])
    alive = [int((lengths > t).sum()) for t in range(lengths[0])]
    at = np.concatenate([[0], np.cumsum(alive)])  # rows of position t stand together
    x = np.concatenate([np.stack([samples[i][0][t] for i in range(alive[t])]) for t in range(lengths[0])])
    y = np.concatenate([np.array([samples[i][1][t] for i in range(alive[t])]) for t in range(lengths[0])])
    barred = np.zeros((len(y), 2))
    barred[y == 0, 1] = -1e9
    barred[y == 1, 0] = -1e9
    lse = np.logaddexp.reduce

    def expected(scores):
        """Marginals of labels and summed marginals of transitions."""
        alpha, beta = scores.copy(), np.zeros_like(scores)
        for t in range(1, len(alive)):
            a, b, n = at[t], at[t - 1], alive[t]
            alpha[a:a + n] += lse(alpha[b:b + n, :, None] + trans[None], axis=1)
        pairs = np.zeros((2, 2))
        total = np.empty(alive[0])
        for t in range(len(alive) - 1, -1, -1):
            a, n = at[t], alive[t]
            end = alive[t + 1] if t + 1 < len(alive) else 0
            total[end:n] = lse(alpha[a + end:a + n], axis=1)
            if end:
                nxt = at[t + 1]
                ahead = scores[nxt:nxt + end] + beta[nxt:nxt + end]
                beta[a:a + end] = lse(trans[None] + ahead[:, None, :], axis=2)
                pairs += np.exp(alpha[a:a + end, :, None] + trans[None] + ahead[:, None, :] - total[:end, None, None]).sum(axis=0)
        z = np.concatenate([total[:n] for n in alive])
        return np.exp(alpha + beta - z[:, None]), pairs

    # adaptive steps: a feature that is rarely set still gets a weight
    sq_e, sq_t = np.full_like(emit, 1e-8), np.full_like(trans, 1e-8)
    for _ in range(steps):
        scores = x @ emit
        free, free_pairs = expected(scores)
        held, held_pairs = expected(scores + barred)
        g_e = x.T @ (held - free) / len(y) - decay * emit
        g_t = (held_pairs - free_pairs) / len(y) - decay * trans
        sq_e += g_e ** 2
        sq_t += g_t ** 2
        emit += rate * g_e / np.sqrt(sq_e)
        trans += rate * g_t / np.sqrt(sq_t)
    return {"emit": emit, "trans": trans}


def decode(model: dict, x: np.ndarray) -> list[int]:
    """Viterbi: the best label of each line (1 content). Ties go to content."""
    s = (x @ model["emit"]).tolist()
    (t00, t01), (t10, t11) = model["trans"].tolist()
    a, b = s[0]
    back = []
    for e0, e1 in s[1:]:
        f0, f1 = b + t10 >= a + t00, b + t11 >= a + t01
        back.append((f0, f1))
        a, b = e0 + (b + t10 if f0 else a + t00), e1 + (b + t11 if f1 else a + t01)
    y = 1 if b >= a else 0
    out = [y]
    for f in reversed(back):
        y = 1 if f[y] else 0
        out.append(y)
    return out[::-1]


def training_blocks(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> DataFrame:
    """(block): line features of the training sample, BLOCK_LINES lines of a text in each row.

    The sample is about ``train_docs`` documents with a text, chosen by a hash of it, whatever its length; equal
    texts count once, so a text in very many rows adds no more than another. If the chosen texts have more than
    ``train_lines`` lines, a hash of text and place chooses among their blocks. Features are those of the whole text."""
    text = F.col("text").cast("string")
    total = docs.count()
    chance = F.pmod(F.xxhash64(F.lit(3), text), F.lit(1 << 30)) / float(1 << 30)
    some = docs.filter((F.length(text) > 0) & (chance < train_docs / max(1, total))).select(text.alias("text")).distinct()
    some = land(some, "line-sample")
    lines = some.agg(F.coalesce(F.sum(F.size(F.split("text", "\n"))), F.lit(0))).first()[0]
    share = min(1.0, train_lines / max(1, lines))

    def cut(batches):
        for batch in batches:
            for part in light_batches([batch], "text", 1 << 20):
                out = []
                for t in part.column("text").to_pylist():
                    data = t.encode("utf-8", "replace")
                    x = line_features(data.split(b"\n"))
                    seed = zlib.crc32(data)
                    for k in range(0, len(x), BLOCK_LINES):
                        if zlib.crc32(k.to_bytes(8, "little"), seed) < share * 2 ** 32:
                            out.append(x[k:k + BLOCK_LINES].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["block"])

    return some.mapInArrow(cut, "block binary")


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> dict:
    """Train on the seed labels of ``training_blocks``; the same rows give the same model."""
    samples = []
    for block in sorted(bytes(r["block"]) for r in training_blocks(docs, train_docs, train_lines).toLocalIterator()):
        x = np.frombuffer(block, dtype=np.float64).reshape(-1, len(FEATURES))
        samples.append((x, seed_labels(x)))
    return train(samples)


def measure(text: str | None, model: dict) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_share, labels)"""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return 0, 0, len(data) - without(data, SYMBOLS), 0, 0, 0.0, []
    lines = data.split(b"\n")
    labels = decode(model, line_features(lines))
    chars = len(text) - (len(data) - without(data, BLANKS))
    weight = [without(line, BLANKS) for line in lines]
    share = sum(w for w, y in zip(weight, labels) if y) / sum(weight)
    return len(words), chars, len(data) - without(data, SYMBOLS), sum(duplicate_lines(lines)), repeated_words(words), share, labels


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > 20 * n_words


COLUMNS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
           "base_failed boolean, kept boolean, content_share double, content_lines bigint, n_lines bigint")


def judge(docs: DataFrame, model: dict | None = None, min_content: float = MIN_CONTENT) -> DataFrame:
    """doc_id and COLUMNS for every document. ``model`` defaults to one trained on a sample of ``docs``."""
    model = model or fit(docs)

    def rows(texts):
        out = {c.split()[0]: [] for c in COLUMNS.split(", ")}
        for t in texts:
            n, chars, symbols, dups, repeats, share, labels = measure(t, model)
            failed = base_failed(n, repeats)
            for name, value in zip(out, (n, chars, symbols, dups, repeats, failed, not failed and share >= min_content,
                                         share, sum(labels), len(labels))):
                out[name].append(value)
        return out

    return per_text(docs, [F.col("doc_id")], rows, COLUMNS)


def keep_documents(docs: DataFrame, model: dict | None = None, min_content: float = MIN_CONTENT) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base rules and the content share."""
    model = model or fit(docs)
    at = docs.columns.index("text")

    def rows(batches):
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in light_batches([named], f"c{at}"):
                keep = []
                for t in part.column(at).to_pylist():
                    n, _, _, _, repeats, share, _ = measure(t, model)
                    keep.append(not base_failed(n, repeats) and share >= min_content)
                part = part.filter(pa.array(keep, type=pa.bool_()))
                yield part.rename_columns(batch.schema.names)

    return docs.mapInArrow(rows, docs.schema)


def labelled_lines(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, line_no, content, line): every line of every text with its label."""
    model = model or fit(docs)

    def rows(texts):
        out = []
        for t in texts:
            labels = measure(t, model)[-1]
            out.append([{"line_no": i, "content": bool(y), "line": s} for i, (y, s) in enumerate(zip(labels, (t or "").split("\n")))])
        return {"lines": out}

    made = per_text(docs, [F.col("doc_id")], rows, "lines array<struct<line_no:bigint,content:boolean,line:string>>")
    return made.select("doc_id", F.inline("lines"))
