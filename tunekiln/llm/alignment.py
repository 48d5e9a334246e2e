"""Alignment of two tokenizers' tokens over the bytes of each text.

Both tokenizers see a blank and the text; tokens are laid out by their bytes. For each batch of texts two
``merge_asof`` joins, keyed by document, give each token start the other side's token that covers it; the union
of both directions is every overlapping pair (a link), once. Offsets where tokens of both sides end cut the
tokens into groups.

What is compared with the whole corpus is an id pair's count, the documents that hold it linked. A batch (lot) is
written as one row with the dictionary of its pairs, so the corpus sees each pair once for each lot: counts are
summed by pair, joined back to the lots' dictionaries (by a broadcast where the counted table is small, else by a
shuffle in which a pair has a row for each lot at most), and meet the lot's documents in a co-group by lot.

Defined cases: a text that is null or empty, or whose tokens' bytes differ from the blank and the text (a
vocabulary may normalise or lack something), has no tokens and counts zero, with '' for its groups; strings of
special tokens are ordinary text; null, repeated and clashing ids are passed through, each row being a document;
an empty table gives an empty result; other columns are ignored. A lot holds LOT_BYTES of text, or one longer
text; memory grows with that.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import land, light_batches
from .tokenizing import Encoder, Pieces

LOT_BYTES = 2 << 20
SMALL_ROWS = 500_000  # counted pairs that are broadcast (32 bytes each)
SHIFT = 32            # a pair is one number: A's id above B's
LOTS = ("lot bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
        "groups_sha256 array<string>, pairs array<bigint>, docs array<bigint>, place binary, times binary, held array<bigint>")


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the
    others follow from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b < 256]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """A tokenizer and the bytes of its ids."""

    def __init__(self, words, names: list[bytes]):
        self.words, self.names = words, np.array(names, dtype=object)
        self.lengths = np.array([len(x) for x in names], dtype=np.int64)
        self.size = len(names)
        # ids as text, followed by what may stand behind them in the groups
        self.comma, self.other, self.end = (np.array([f"{i}{c}" for i in range(len(names))], dtype=object) for c in ",|;")


@lru_cache(maxsize=1)
def sides(a: str | None = None, b: str | None = None) -> tuple[Side, Side]:
    left, right = Encoder(a, plain_marks=True), Pieces(b)
    alphabet = byte_alphabet()
    names = [b""] * left.lib.get_vocab_size()
    marks = {t.content for t in left.lib.get_added_tokens_decoder().values()}
    for word, i in left.lib.get_vocab().items():
        names[i] = word.encode() if word in marks else bytes(alphabet[c] for c in word)
    lib = right.lib
    pieces = [bytes([int(lib.id_to_piece(i)[1:-1], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace("▁", " ").encode() for i in range(lib.get_piece_size())]
    return Side(left, names), Side(right, pieces)


def _tokens(side: Side, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids, n = side.words.flat(pa.array(texts, pa.string()), bare=False)
    return ids.astype(np.int64), n


def _spoilt(side: Side, ids: np.ndarray, n: np.ndarray, data: list[bytes]) -> np.ndarray:
    """Whether the joined bytes of a text's tokens differ from the blank and the text."""
    doc = np.repeat(np.arange(len(n)), n)
    bad = np.bincount(doc, side.lengths[ids], len(n)).astype(np.int64) != [len(d) for d in data]
    if not bad.any() and b"".join(side.names[ids].tolist()) == b"".join(data):
        return bad
    ends = np.cumsum(n)
    return np.array([b"".join(side.names[ids[e - k:e]].tolist()) != d for e, k, d in zip(ends.tolist(), n.tolist(), data)])


def cover(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of all overlapping tokens. The frames have (at, doc, k): a token's first byte, its
    document and its number, sorted; the tokens of a document lie end to end on both sides."""
    there = pd.merge_asof(a, b.rename(columns={"k": "j"}), on="at", by="doc")["j"].to_numpy()
    back = pd.merge_asof(b, a.rename(columns={"k": "i", "at": "begin"}).assign(at=a["at"]), on="at", by="doc")
    inside = (back["begin"] != back["at"]).to_numpy()  # equal starts were found in the first direction
    return np.concatenate([a["k"].to_numpy(), back["i"].to_numpy()[inside]]), np.concatenate([there, b["k"].to_numpy()[inside]])


def align(texts: list[str | None], a: Side, b: Side) -> dict:
    """One lot: counts and group digests by document, and its distinct pairs with their documents."""
    n_docs = len(texts)
    out = {c: np.zeros(n_docs, dtype=np.int64) for c in ("n_a", "n_b", "n_groups", "n_links", "held")}
    shas = [""] * n_docs
    filled = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
    some = [texts[i] for i in filled.tolist()]
    (ids_a, na), (ids_b, nb) = _tokens(a, some), _tokens(b, some)
    data = [b" " + t.encode() for t in some]
    bad = _spoilt(a, ids_a, na, data) | _spoilt(b, ids_b, nb, data)
    if bad.any():
        ids_a, ids_b = ids_a[np.repeat(~bad, na)], ids_b[np.repeat(~bad, nb)]
        filled, na, nb = filled[~bad], na[~bad], nb[~bad]
    none = np.zeros(0, dtype=np.int64)
    if len(filled) == 0:
        return out | {"groups_sha256": shas, "pairs": none, "docs": none, "place": none, "times": none}
    out["n_a"][filled], out["n_b"][filled] = na, nb
    doc_a, doc_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    # documents lie one after the other, so the offsets of all of them ascend
    end_a, end_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    frame = lambda doc, at: pd.DataFrame({"at": at, "doc": doc, "k": np.arange(len(at))})
    i, j = cover(frame(doc_a, end_a - a.lengths[ids_a]), frame(doc_b, end_b - b.lengths[ids_b]))
    out["n_links"][filled] = np.bincount(doc_a[i], minlength=len(na))
    # groups end where both sides end
    cut = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
    out["n_groups"][filled] = np.bincount(doc_a[np.searchsorted(end_a, cut)], minlength=len(na))
    _digests(shas, filled, a, b, ids_a, ids_b, na, nb, end_a, end_b, cut, group_a, group_b)
    # distinct pairs of each document, with their occurrences
    key = doc_a[i] << SHIFT
    pair, at = np.unique(ids_a[i] << SHIFT | ids_b[j], return_inverse=True)
    held, times = np.unique(key | at, return_counts=True)
    place = held & ((1 << SHIFT) - 1)
    out["held"][filled] = np.bincount(held >> SHIFT, minlength=len(na))
    return out | {"groups_sha256": shas, "pairs": pair, "docs": np.bincount(place, minlength=len(pair)), "place": place, "times": times}


def _digests(shas, filled, a, b, ids_a, ids_b, na, nb, end_a, end_b, cut, group_a, group_b) -> None:
    last_a, last_b = np.isin(end_a, cut, assume_unique=True), np.isin(end_b, cut, assume_unique=True)
    # A's tokens of a group stand before B's: each is moved by the other side's tokens before it
    before_b = np.searchsorted(group_b, group_a, "left")
    before_a = np.searchsorted(group_a, group_b, "right")
    parts = np.empty(len(ids_a) + len(ids_b), dtype=object)
    parts[np.arange(len(ids_a)) + before_b] = np.where(last_a, a.other[ids_a], a.comma[ids_a])
    parts[np.arange(len(ids_b)) + before_a] = np.where(last_b, b.end[ids_b], b.comma[ids_b])
    parts, start = parts.tolist(), 0
    for k, n in zip(filled.tolist(), (na + nb).tolist()):
        text = "".join(parts[start:start + n])
        shas[k] = hashlib.sha256(text[:-1].encode()).hexdigest()  # without the last ';'
        start += n


def lots(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """One written row for each lot of documents (see LOTS)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        left, right = sides(a, b)
        number = TaskContext.get().partitionId() << SHIFT
        for batch in light_batches(batches, "text", LOT_BYTES):
            made = align(batch.column("text").to_pylist(), left, right)
            lists = {c: [made[c]] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "docs", "held")}
            lists |= {"lot": [number], "doc_id": [batch.column("doc_id").to_pylist()]} | {c: [made[c].astype("<u4").tobytes()] for c in ("place", "times")}
            yield pa.RecordBatch.from_pydict({f.name: lists[f.name] for f in shape}, schema=shape)
            number += 1
        left.words.rest()
        right.words.rest()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    shape = to_arrow_schema(StructType.fromDDL(LOTS))
    return land(rows.mapInArrow(run, LOTS), "align-lots")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best): the documents of each linked id pair, and whether its A id has no pair of more."""
    each = found.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("count"))
    of_a = Window.partitionBy(F.shiftright("pair", SHIFT))  # at most B's vocabulary
    return land(each.withColumn("best", F.col("count") == F.max("count").over(of_a)), "align-counts")


def alignment(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    found = lots(docs, a, b)
    counts = pair_counts(found)
    counts = F.broadcast(counts) if counts.count() <= SMALL_ROWS else counts
    each = found.select(F.col("lot").alias("of"), F.posexplode("pairs").alias("k", "pair")).join(counts, "pair").select("of", "k", "count", "best")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        order = np.argsort(right.column("k").to_numpy())
        count, best = right.column("count").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order]
        for r in left.to_pylist():  # one row
            place, times = (np.frombuffer(r[c], dtype="<u4").astype(np.int64) for c in ("place", "times"))
            held = np.array(r["held"], dtype=np.int64)
            doc = np.repeat(np.arange(len(held)), held)
            total = np.zeros(len(held), dtype=np.int64)
            np.add.at(total, doc, times * count[place])
            n_best = np.bincount(doc[best[place]], times[best[place]], len(held)).astype(np.int64)
            parts.append(pa.table({"doc_id": pa.array(r["doc_id"], pa.int64()), **{c: pa.array(r[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")},
                                   "n_best": n_best, "count_sum": total, "groups_sha256": pa.array(r["groups_sha256"], pa.string())}))
        return pa.concat_tables(parts) if parts else empty

    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    empty = pa.table({f.split()[0]: pa.array([], pa.string() if f.endswith("string") else pa.int64()) for f in schema.split(", ")})
    narrow = found.drop("pairs", "docs")
    return narrow.groupBy("lot").cogroup(each.groupBy("of")).applyInArrow(finish, schema)
