"""Class-based bigram language model (Brown classes by exchange clustering).

Tokens are the words of a text, A-Z lower-cased, and one end token. Words get classes:

- the ``HEAD`` most frequent words are clustered into ``CLASSES`` classes by the exchange algorithm, which moves
  each word to the class that raises the class bigram likelihood most, over and over. It needs their bigram
  counts alone, at most HEAD x HEAD numbers gathered from all training texts;
- every other training word, however rare, then makes its move: all of them start in one class of their own, and each
  goes from it to the class that raises the likelihood most, by its counts of neighbours in all training texts (the
  class of a head word, the end, or another word of that start class). Words are dealt over the tasks with their
  counts, which are added up there (``_neighbours``, ``_gather``, ``_assign``);
- the end token is a class, and so are words that training never saw.

P(word | previous word) = P(class | previous class) x P(word | class), both with add-one smoothing. Transitions are
counted with each training word left out of its own count (a word seen once counts as unseen, and so on), which is
how such words will look in other texts. Every count covers all training texts.

Word counts grow with the corpus and are never broadcast. Texts are dealt into chunks by ranges of ids; a chunk
sends its distinct words with counts (pre-aggregated) to the tasks of the words, where a window over each word adds
them up, and gets the totals of its training words sent back. Chunk and counts meet in a co-group of bounded size
(``CHUNK_ROWS`` documents), which leaves for each document its counts by class bigram. Transition and emission
totals, of a size fixed by the number of classes, then turn these into scores. Scratch tables and shuffle files go
as soon as the next table is written, so that disk holds two steps at most.

Defined cases: null texts are empty, and empty texts are the end token alone; null ids belong to the training
fold and the first chunk; without training texts all counts are 0; repeated rows count each for itself; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fold, free_shuffles, land, light_batches

HEAD = 500
CLASSES = 24
ROUNDS = 4
CHUNK_ROWS = 8000
FLUSH = 200_000  # distinct words that a task holds before it sends their counts
TOKENS = 1_000_000  # tokens that a task holds before it sends the neighbours of their words
END = CLASSES
UNSEEN = CLASSES + 1
ALL = UNSEEN + 1
OTHER = CLASSES + 1  # while classes are learnt: the class in which words beyond the head start
SIDE = CLASSES + 2   # classes that a neighbour can have then
OWN = 2 * SIDE       # a word beside itself
WORDS_AT_ONCE = 4000
MOST = 0xFFFFFF  # largest count in a 4-byte number of ``near``


def split(text: str | None) -> list[bytes]:
    """Words of a text: bytes.lower and bytes.split know A-Z and the six ASCII blanks only."""
    return (text or "").encode("utf-8", "replace").lower().split()


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each word from a square matrix of bigram counts whose last row and column are the end token.

    Words start in classes by rank; each is then moved to the class with the best class bigram likelihood."""
    m = len(bigrams) - 1
    of = np.concatenate([np.arange(m) % classes, [classes]])
    k = classes + 1

    def xlogx(a):
        return a * np.log(np.maximum(a, 1))

    member = np.zeros((m + 1, k))
    member[np.arange(m + 1), of] = 1
    n = member.T @ bigrams @ member
    for _ in range(rounds):
        moved = 0
        for w in range(m):
            own = bigrams[w, w]
            old = of[w]
            member[w, old] = 0
            right, left = bigrams[w] @ member, bigrams[:, w] @ member  # to and from the classes, w itself left out
            n[old] -= right
            n[:, old] -= left
            n[old, old] -= own
            tries = np.repeat(n[None], classes, axis=0)
            i = np.arange(classes)
            tries[i, i] += right
            tries[i, :, i] += left
            tries[i, i, i] += own
            value = xlogx(tries).sum(axis=(1, 2)) - xlogx(tries.sum(axis=2)).sum(axis=1) - xlogx(tries.sum(axis=1)).sum(axis=1)
            best = int(value.argmax())
            if value[best] <= value[old] + 1e-9:
                best = old
            moved += best != old
            of[w] = best
            member[w, best] = 1
            n = tries[best].copy()
        if not moved:
            break
    return of[:m]


def best_class(n: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Class of each word that starts in class OTHER: the one with the best class bigram likelihood after its move.

    ``n`` has the class bigrams of all words before any moves; ``left`` and ``right`` (words x classes) count a word's
    neighbours before and behind it by class, without ``own``, the times that it stands beside itself."""
    def xlogx(a):
        return a * np.log(np.maximum(a, 1))

    k = np.arange(CLASSES)
    out = np.empty(len(own), dtype=np.int8)
    for a in range(0, len(own), WORDS_AT_ONCE):
        x, y, z = left[a:a + WORDS_AT_ONCE], right[a:a + WORDS_AT_ONCE], own[a:a + WORDS_AT_ONCE, None]
        cell = n[k, k]
        value = np.zeros((len(x), CLASSES))
        for table, add, gone in ((n[:CLASSES].T, y, x), (n[:, :CLASSES], x, y)):
            w, j = np.nonzero(add)
            if not len(w):
                continue
            before = table[j]
            before[j == OTHER] -= gone[w[j == OTHER], :CLASSES]  # the word has left OTHER
            gain = xlogx(before + add[w, j][:, None]) - xlogx(before)
            first = np.flatnonzero(np.diff(w, prepend=-1))
            value[w[first]] += np.add.reduceat(gain, first)
        # a class beside itself is in a row and a column, but one number
        value += xlogx(cell + x[:, :CLASSES] + y[:, :CLASSES] + z) + xlogx(cell)
        value -= xlogx(cell + y[:, :CLASSES]) + xlogx(cell + x[:, :CLASSES])
        for total, more in ((n.sum(axis=1)[k], y), (n.sum(axis=0)[k], x)):
            value -= xlogx(total + more.sum(axis=1, keepdims=True) + z) - xlogx(total)
        value[:, n.sum(axis=0)[k] == 0] = -np.inf  # every word would see the same empty class as its own
        out[a:a + WORDS_AT_ONCE] = value.argmax(axis=1)
    return out


def _chunked(docs: DataFrame, held_out) -> DataFrame:
    """(doc_id, held_out, chunk, text); chunks are ranges of ids of about CHUNK_ROWS rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // CHUNK_ROWS))
    cuts = sorted(set(rows.filter("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    # one number per chunk, searched by halving
    return rows.withColumn("chunk", _place(F.col("doc_id").cast("double"), cuts, 0, len(cuts)))


def _place(x, cuts: list[float], a: int, b: int):
    """Number of cuts at or below x, as nested comparisons; null: 0."""
    if a == b:
        return F.lit(a)
    m = (a + b) // 2
    return F.when(x >= F.lit(cuts[m]), _place(x, cuts, m + 1, b)).otherwise(_place(x, cuts, a, m))


def _words(rows: DataFrame) -> DataFrame:
    """(chunk, word, n): training count of each distinct word of a chunk, in part; 0 where only held-out
    texts have it."""
    def count(batches):
        held: dict[int, Counter] = {}
        size = 0

        def out():
            for chunk, words in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(words), pa.int32()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())],
                                                 names=["chunk", "word", "n"])
        for batch in light_batches(batches, "text"):
            for chunk, out_of, text in zip(*[batch.column(c).to_pylist() for c in ("chunk", "held_out", "text")]):
                words = held.setdefault(chunk, Counter())
                size -= len(words)
                words.update(dict.fromkeys(split(text), 0) if out_of else split(text))
                size += len(words)
            if size > FLUSH:
                yield from out()
                held, size = {}, 0
        yield from out()

    return rows.select("chunk", "held_out", "text").mapInArrow(count, "chunk int, word binary, n bigint")


def _head_bigrams(rows: DataFrame, head: list[bytes]) -> np.ndarray:
    """Counts of neighbours among the head words and the end token (last row and column)."""
    ids = {w: i for i, w in enumerate(head)}
    m = len(head) + 1

    def count(batches):
        held = np.zeros(m * m, dtype=np.int64)
        for batch in light_batches(batches, "text"):
            seq = [m - 1]
            for text in batch.column("text").to_pylist():
                seq += [ids.get(w, -1) for w in split(text)]
                seq.append(m - 1)
            a = np.array(seq)
            ok = (a[:-1] >= 0) & (a[1:] >= 0)
            held += np.bincount(a[:-1][ok] * m + a[1:][ok], minlength=m * m)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], names=["pair", "n"])

    found = rows.filter("not held_out").select("text").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(m * m)
    out[found["pair"].to_numpy(dtype=np.int64)] = found["n"]
    return out.reshape(m, m)


def _neighbours(rows: DataFrame, classes: dict[bytes, int]) -> DataFrame:
    """(word, near): for each training word beyond the head, in part, how often its neighbours are of which class, as
    4-byte numbers of kind (1 byte) and count. Rows without a word have the bigrams of classes: (pair, n), in part."""
    schema = pa.schema([("word", pa.binary()), ("near", pa.binary()), ("pair", pa.int64()), ("n", pa.int64())])

    def batch_of(**cols):
        m = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(m, f.type)) for f in schema], schema=schema)

    def count(batches):
        def out(place, words, cls):
            a, b = cls[:-1], cls[1:]
            u, v = words[:-1], words[1:]
            same = (u == v) & (u >= 0)
            keys = np.concatenate([v * 64 + np.where(same, OWN, a), u * 64 + SIDE + b])
            keys, times = np.unique(keys[np.concatenate([v >= 0, (u >= 0) & ~same])], return_counts=True)
            near = ((keys & 63) << 24 | times).astype("<u4")
            ends = np.searchsorted(keys >> 6, np.arange(len(place) + 1)) * 4
            near = pa.BinaryArray.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(near)])
            whole = batch_of(word=pa.array(list(place), pa.binary()), near=near)
            yield from (whole.slice(i, 20_000) for i in range(0, len(place), 20_000))

        pairs = np.zeros(SIDE * SIDE, dtype=np.int64)
        place: dict[bytes, int] = {}
        words, cls, size = [], [], 0
        for batch in light_batches(batches, "text"):
            w, c = [-1], [END]
            for text in batch.column("text").to_pylist():
                for x in split(text):
                    k = classes.get(x, OTHER)
                    c.append(k)
                    w.append(place.setdefault(x, len(place)) if k == OTHER else -1)
                c.append(END)
                w.append(-1)
            words.append(np.array(w, dtype=np.int64))
            cls.append(np.array(c, dtype=np.int64))
            size += len(w)
            pairs += np.bincount(cls[-1][:-1] * SIDE + cls[-1][1:], minlength=len(pairs))
            if len(place) > FLUSH or size > TOKENS:
                yield from out(place, np.concatenate(words), np.concatenate(cls))
                place, words, cls, size = {}, [], [], 0
        if place:
            yield from out(place, np.concatenate(words), np.concatenate(cls))
        at = np.flatnonzero(pairs)
        yield batch_of(pair=pa.array(at, pa.int64()), n=pa.array(pairs[at], pa.int64()))

    return rows.filter("not held_out").select("text").mapInArrow(count, "word binary, near binary, pair bigint, n bigint")


def _gather(near: DataFrame) -> DataFrame:
    """``near`` with one row for each word: its counts are added up. Rows without a word stay as they are."""
    def gather(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            bare = pc.is_null(t["word"])
            if pc.any(bare).as_py():
                yield from t.filter(bare).to_batches()
                t = t.filter(pc.invert(bare))
            t = t if held is None else pa.concat_tables([held, t])
            if not len(t):
                continue
            # the last word may go on in the next batch
            last = len(t) - 1
            while last > 0 and t["word"][last - 1] == t["word"][last]:
                last -= 1
            held = t.slice(last)
            if last:
                yield added(t.slice(0, last))
        if held is not None:
            yield added(held)

    def added(t: pa.Table) -> pa.RecordBatch:
        words, full = _unpacked(t)
        m = len(words)
        at, kind = np.nonzero(full)
        times = full[at, kind].astype(np.int64)
        # a count that is too large for one number takes several
        lots = -(-times // MOST)
        at, kind, part = np.repeat(at, lots), np.repeat(kind, lots), np.full(lots.sum(), MOST)
        part[np.cumsum(lots) - 1] = times - MOST * (lots - 1)
        ends = np.searchsorted(at, np.arange(m + 1)) * 4
        found = pa.BinaryArray.from_buffers(pa.binary(), m, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer((kind << 24 | part).astype("<u4"))])
        return pa.RecordBatch.from_arrays([words, found, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=["word", "near", "pair", "n"])

    return near.repartition("word").sortWithinPartitions("word").mapInArrow(gather, "word binary, near binary, pair bigint, n bigint")


def _unpacked(t: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of rows (word, near), and their counts by kind."""
    words = t["word"].combine_chunks().dictionary_encode()
    per = pc.binary_length(t["near"]).to_numpy() // 4
    at = np.repeat(words.indices.to_numpy().astype(np.int64), per)
    near = np.frombuffer(b"".join(t["near"].to_pylist()), "<u4")
    m = len(words.dictionary)
    return words.dictionary, np.bincount(at * (OWN + 1) + (near >> 24), weights=near & 0xFFFFFF, minlength=m * (OWN + 1)).reshape(m, OWN + 1)


def _assign(near: DataFrame, n: np.ndarray) -> DataFrame:
    """(word, class) of every word of ``near``, which has one row for each: it makes its move."""
    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words, full = _unpacked(pa.Table.from_batches([batch]))
            found = best_class(n, full[:, :SIDE], full[:, SIDE:OWN], full[:, OWN])
            yield pa.RecordBatch.from_arrays([words, pa.array(found, pa.int8())], names=["word", "class"])

    return near.select("word", "near").mapInArrow(assign, "word binary, class byte")


def score(docs: DataFrame, held_out=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row."""
    held_out = fold(F.col("doc_id"), 7) == 2 if held_out is None else held_out
    spark, rows = docs.sparkSession, _chunked(docs, held_out)
    by_word = Window.partitionBy("word")
    # dealt by word before they are added up by chunk and word: one shuffle does for the window too
    parts = _words(rows).repartition("word").groupBy("chunk", "word").agg(F.sum("n").alias("n"))
    counts = land(parts.select("chunk", "word", F.sum("n").over(by_word).alias("c"),
                  (F.min("chunk").over(by_word) == F.col("chunk")).alias("lead")).filter("c > 0"), "lm-words")
    free_shuffles(rows)
    words = counts.filter("lead").select("word", "c")
    ends = rows.filter("not held_out").count()
    totals = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    head = {bytes(r["word"]): r["c"] for r in words.orderBy(F.desc("c"), "word").limit(HEAD).collect()}
    classes = dict(zip(head, exchange(_head_bigrams(rows, list(head))).tolist())) if head else {}

    # each chunk gets the totals and classes of its training words
    near = land(_gather(_neighbours(rows, classes)), "lm-neighbours")
    free_shuffles(rows)
    found = near.filter("word is null").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(SIDE * SIDE)
    pairs[found["pair"].to_numpy(dtype=np.int64)] = found["n"]
    kinds = _assign(near.filter("word is not null"), pairs.reshape(SIDE, SIDE))
    if classes:
        kinds = kinds.unionByName(spark.createDataFrame([(bytearray(w), k) for w, k in classes.items()], "word binary, class byte"))
    known = land(counts.join(kinds, "word"), "lm-classes")
    discard(counts, near)
    free_shuffles(rows)
    back = known.select("chunk", "word", "c", "class")

    def chunk_rows(left: pa.Table, right: pa.Table) -> pa.Table:
        # the training words of the chunk have a place each; place 0 is for words that training never saw
        place: dict[bytes, int] = {}
        for batch in right.select(["word"]).to_batches(max_chunksize=20_000):
            place.update(zip(batch.column(0).to_pylist(), range(len(place) + 1, len(place) + 1 + batch.num_rows)))
        c = np.concatenate([[0], right.column("c").to_numpy()]).astype(np.int64)
        kind = np.concatenate([[UNSEEN], right.column("class").to_numpy()]).astype(np.uint8)
        left_out = np.where(c > 1, kind, UNSEEN)
        logs = np.log10(c + 1.0)
        log_end, cols = math.log10(ends + 1), ([], [], [], [], [])
        moves = np.zeros(ALL * ALL, dtype=np.int64)

        def bigrams(kinds):
            full = np.concatenate([[END], kinds.astype(np.int64), [END]])
            return full[:-1] * ALL + full[1:]

        for text, out_of in zip(left.column("text"), left.column("held_out").to_pylist()):
            words_ = split(text.as_py())
            at = np.fromiter((place.get(w, 0) for w in words_), dtype=np.int64, count=len(words_))
            if not out_of:
                moves += np.bincount(bigrams(left_out[at]), minlength=len(moves))
            pair, times = np.unique(bigrams(kind[at]), return_counts=True)
            for col, x in zip(cols, (len(at) + 1, int((c[at] > 0).sum()) + (ends > 0), math.fsum(logs[at]) + log_end,
                                     pair.astype("<u2").tobytes(), times.astype("<u4").tobytes())):
                col.append(x)
        # one more row holds the chunk's transitions
        at = np.flatnonzero(moves)
        for col, x in zip(cols, (None, None, None, at.astype("<u2").tobytes(), moves[at].astype("<u4").tobytes())):
            col.append(x)
        made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary()))]
        ids = [pa.array(left.column(c).to_pylist() + [None], t) for c, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()))]
        return pa.Table.from_arrays([*ids, *made], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "pairs", "times"])

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, pairs binary, times binary"
    sizes = known.filter("lead").groupBy(F.col("class").alias("k")).agg(F.count(F.lit(1)).alias("t"), F.sum("c").alias("s")).collect()
    seen = land(rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(chunk_rows, schema), "lm-documents")
    discard(known)
    free_shuffles(rows)

    def add_up(batches):
        held = np.zeros(ALL * ALL, dtype=np.int64)
        for batch in batches:
            for p, t in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                held[np.frombuffer(p, "<u2")] += np.frombuffer(t, "<u4")
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], names=["pair", "n"])

    found = seen.filter("n_tokens is null").select("pairs", "times").mapInArrow(add_up, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    moves = np.zeros(ALL * ALL)
    moves[found["pair"].to_numpy(dtype=np.int64)] = found["n"]
    moves = moves.reshape(ALL, ALL)
    # words and distinct words of each class
    tokens, types = np.zeros(ALL), np.zeros(ALL)
    for r in sizes:
        types[r["k"]], tokens[r["k"]] = r["t"], r["s"]
    tokens[END], types[END] = ends, ends > 0
    turn = np.log10((moves + 1) / (moves.sum(axis=1, keepdims=True) + ALL))
    emit = np.log10(tokens + types + 1)
    emit[UNSEEN] = math.log10(v + 1)  # an unseen word: one of as many as are known, and one more
    table = turn - emit[None, :]
    base = math.log10(n + v + 1)

    def finish(batches):
        flat = table.ravel()
        for b in batches:
            move = [float(flat[np.frombuffer(p, "<u2")] @ np.frombuffer(t, "<u4")) for p, t in zip(b.column("pairs").to_pylist(), b.column("times").to_pylist())]
            k = b.column("n_tokens").to_numpy()
            logs = b.column("logs").to_numpy()
            s = logs + np.array(move, dtype=float)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), b.column("n_tokens"), b.column("n_known"), pa.array([n] * b.num_rows, pa.int64()),
                 pa.array(logs - k * base), pa.array(s), pa.array(10 ** (-s / k))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return seen.filter("n_tokens is not null").mapInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
