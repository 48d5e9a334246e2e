"""Quality scores by Bradley-Terry pairwise ranking.

A document's utility is a linear function of features of its whole text. Preference pairs set a document
labelled 1 above one labelled 0; the weights minimise the logistic loss of the pairs' feature differences
(Newton steps). The cut between good and bad is a quantile of the training utilities, and the utility is
mapped to 0..1 so that this cut stands at ``CUT``.

Training reads every labelled document, and each stands in pairs: both classes are numbered by a hash of the id, and
each document of the larger class meets ``OPPONENTS`` of the smaller in turn (more where that gives fewer than ``PAIRS``
pairs, all at most). Features of all texts are written once. Labelled ones (features and labels, no texts) are shuffled
to the labels by id and paired in a join; a document of a small class is repeated, so that no task gathers all its
pairs. Newton steps and the cut's counts are sums over the written rows: the driver gets one vector of sums from a
task, and ``BINS`` counts of utilities. Scoring is row by row over all documents' features.

Defined cases: null and empty texts have zero features and a score; labels without a document, null labels
and null ids are ignored; repeated labels of a document count by their mean (1 if at least a half); equal rows of one id train
once; where one class has no example every score is 0.5; an empty table gives an empty result; labels, lang, source
and other columns never enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import discard, fold, land, per_text
from .texts import BLANKS, SYMBOLS, duplicate_lines, repeated_words, without

OPPONENTS = 4
PAIRS = 30000
DECAY = 1e-3
BINS = 1 << 16
PART_ROWS = 4096  # numbered by one window
LOT_PAIRS = 512  # of one document of the smaller class, before it is repeated
CUT = 0.3
SEED = 7
_KIND = np.zeros(256, dtype=np.int64)  # byte classes: 0 other
for _k, _chars in enumerate((BLANKS, SYMBOLS, bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"!?", b".,;:", b"\"'()[]{}_-=+/\\@^`~")):
    _KIND[list(_chars)] = _k + 1
_KIND[128:] = 9
KINDS = 10


def text_features(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    kinds = np.bincount(_KIND[np.frombuffer(data, dtype=np.uint8)], minlength=KINDS).astype(float)
    solid = max(1.0, len(data) - kinds[1])
    letters = max(1.0, kinds[3] + kinds[4])
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = data.split(b"\n")
    full = [x for x in lines if x.strip(BLANKS)]
    short = sum(len(x) < 30 for x in full) / len(full)
    out = [np.log1p(n), solid / n / 10, kinds[2] / solid * 10, kinds[3] / letters, kinds[5] / solid * 5, kinds[6] / solid * 10,
           kinds[7] / solid * 5, kinds[8] / solid * 5, kinds[9] / solid, data.count(b"|") / n, data.count(b"!!") / n,
           len(counts) / n, max(counts.values()) / n, sum(duplicate_lines(lines)) / len(full), repeated_words(words) / n,
           short, np.log1p(n / len(full)), n < 20, n < 50]
    out = [min(float(x), 10.0) for x in out]
    return out + [np.sqrt(abs(x)) for x in out[2:16]]


N_FEATURES = 19 + 14


def features(docs: DataFrame) -> DataFrame:
    return per_text(docs, [F.col("doc_id")], lambda texts: {"x": [text_features(t) for t in texts]}, "x array<double>")


def pair_sums(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of feature differences, one row a pair: curvature and gradient of the loss, and the number of pairs, in one vector."""
    p = 1 / (1 + np.exp(np.clip(z @ w, -30, 30)))  # chance that the pair is ordered wrongly
    return np.concatenate([((z * (p * (1 - p))[:, None]).T @ z).ravel(), z.T @ p, [len(z)]])


def newton(sums, width: int, decay: float = DECAY) -> np.ndarray:
    """Weights that minimise the loss whose ``pair_sums`` over all pairs ``sums(w)`` gives."""
    w = np.zeros(width)
    for _ in range(15):
        s = sums(w)
        h, g, n = s[:width * width].reshape(width, width), s[width * width:-1], s[-1]
        step = np.linalg.solve(h / n + decay * np.eye(width), g / n - decay * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def choose_cut(n: np.ndarray, n_good: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[float, float]:
    """(cut, quantile) that parts the classes best. Given are bins of ascending utilities: rows, good ones, least and
    greatest utility. Quantiles are interpolated between bins and are else the least utility of their bin, so that every
    cut is judged by all rows."""
    good, bad = n_good.sum(), (n - n_good).sum()
    share = bad / (good + bad)
    grid = np.unique(np.concatenate([np.linspace(0, 1, 401), [share]]))
    ends, place = np.cumsum(n), grid * (good + bad - 1)
    at = np.searchsorted(ends, np.floor(place), side="right")
    after = np.searchsorted(ends, np.ceil(place), side="right")
    cuts = np.where(after > at, high[at] + (place - np.floor(place)) * (low[after] - high[at]), low[at])
    good_before = np.cumsum(n_good) - n_good
    right = ((good - good_before[after]) / good + (ends - n - good_before)[after] / bad) / 2
    best = max(range(len(grid)), key=lambda i: (round(right[i], 6), -abs(grid[i] - share)))
    return float(cuts[best]), float(grid[best])


def _scale(spread: float) -> float:
    return min(4.0, 8.0 / max(1e-6, spread)) if spread > 2 else 1.0


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, decay: float = DECAY, seed: int = SEED) -> dict | None:
    """``learn`` for arrays, with ``pairs`` random pairs: weights, the quantile cut and the scale of the score."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / std
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = newton(lambda w: pair_sums(d, w), d.shape[1], decay)
    u = z @ w
    values, at, n = np.unique(u, return_inverse=True, return_counts=True)
    cut, quantile = choose_cut(n, np.bincount(at, weights=y, minlength=len(n)), values, values)
    return {"mean": mean, "std": std, "w": w, "cut": cut, "quantile": quantile, "scale": _scale(u[good].mean() - u[bad].mean())}


def utility_to_score(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    u = ((x - model["mean"]) / model["std"]) @ model["w"]
    s = np.clip((u - model["cut"]) * model["scale"] + np.log(CUT / (1 - CUT)), -30, 30)
    score = 1 / (1 + np.exp(-s))
    # rounding must not move the cut itself below CUT
    return np.where(u >= model["cut"], np.maximum(score, CUT), np.minimum(score, np.nextafter(CUT, 0)))


def training_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y, x) of all labelled documents, from the ``features`` of all."""
    chosen = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
              .agg(F.avg("quality").alias("q")).select("doc_id", (F.col("q") >= 0.5).cast("int").alias("y")))
    return rows.join(chosen, "doc_id").select("doc_id", "y", "x").distinct()


def numbered(rows: DataFrame) -> DataFrame:
    """Adds n, from 0 for each y in the order of a hash of the id. ``rows`` are read twice."""
    parts = max(1, rows.count() // PART_ROWS)
    placed = rows.withColumn("_h", F.xxhash64(F.lit(5), "doc_id")).withColumn("_part", F.pmod("_h", F.lit(parts)))
    # one row a part and class is all that this window orders
    before = Window.partitionBy("y").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("y", "_part").agg(F.count(F.lit(1)).alias("_n")).select("y", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("y", "_part").orderBy("_h", "doc_id", "x"))
    return (placed.withColumn("n", own.cast("long") - 1).join(starts, ["y", "_part"])
            .select("doc_id", "y", "x", (F.col("n") + F.col("_start")).alias("n")))


def preference_pairs(train: DataFrame, good: int, bad: int, opponents: int = OPPONENTS, least: int = PAIRS) -> DataFrame:
    """(n, slot, d): numbers in the larger and in the smaller class, and features of the good less those of the bad document.
    Every training row stands in a pair."""
    many, few = max(good, bad), min(good, bad)
    rounds = min(few, max(opponents, -(-least // many)))
    lots = max(1, many * rounds // (few * LOT_PAIRS))
    larger = int(good >= bad)
    left = (train.filter(F.col("y") == larger).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
            .select("n", F.pmod(F.col("n") + F.col("_k"), F.lit(few)).alias("slot"), F.pmod(F.floor(F.col("n") / F.lit(few)), F.lit(lots)).alias("_lot"),
                    F.col("x").alias("_a")))
    right = (train.filter(F.col("y") == 1 - larger)
             .select(F.col("n").alias("slot"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("_lot"), F.col("x").alias("_b")))
    differ = F.zip_with("_a", "_b", (lambda a, b: a - b) if larger else (lambda a, b: b - a))
    return left.join(right, ["slot", "_lot"]).select("n", "slot", differ.alias("d")).sortWithinPartitions("n", "slot")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_FEATURES)


def _sums(rows: DataFrame, fn, width: int) -> np.ndarray:
    """Sum of the vectors ``fn(batch)``. One vector a task reaches the driver; they are added in a fixed order."""
    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += fn(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    found = sorted(r["s"] for r in rows.mapInArrow(run, "s array<double>").collect())
    return np.array(found, dtype=float).reshape(-1, width).sum(axis=0)


def learn(train: DataFrame) -> dict | None:
    """Weights from preference pairs of all training rows, the quantile cut and the scale of the score."""
    def moments(batch):
        x, y = _matrix(batch.column("x")), batch.column("y").to_numpy()
        return np.concatenate([[y.sum(), len(y)], x.sum(axis=0), (x * x).sum(axis=0)])

    total = _sums(train.select("x", "y"), moments, 2 + 2 * N_FEATURES)
    good, n = int(total[0]), int(total[1])
    if good in (0, n):
        return None
    mean = total[2:2 + N_FEATURES] / n
    std = np.sqrt(np.maximum(0, total[2 + N_FEATURES:] / n - mean * mean)) + 1e-6
    pairs = land(preference_pairs(train, good, n - good), "ranking-pairs")
    w = newton(lambda w: _sums(pairs.select("d"), lambda batch: pair_sums(_matrix(batch.column("d")) / std, w), N_FEATURES * N_FEATURES + N_FEATURES + 1), N_FEATURES)
    discard(pairs)

    def utilities(batches):
        for batch in batches:
            u = ((_matrix(batch.column("x")) - mean) / std) @ w
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(u)], names=["y", "u"])

    u = train.select("x", "y").mapInArrow(utilities, "y int, u double")
    low, high, of_good, of_bad = u.agg(F.min("u"), F.max("u"), F.avg(F.when(F.col("y") == 1, F.col("u"))), F.avg(F.when(F.col("y") == 0, F.col("u")))).first()
    place = F.floor((F.col("u") - F.lit(low)) * F.lit((BINS - 1) / max(high - low, 1e-9)))
    bins = u.groupBy(place.alias("bin")).agg(F.count("u").alias("n"), F.sum("y").alias("good"), F.min("u").alias("low"), F.max("u").alias("high")).toPandas().sort_values("bin")
    cut, quantile = choose_cut(*(bins[c].to_numpy() for c in ("n", "good", "low", "high")))
    return {"mean": mean, "std": std, "w": w, "cut": cut, "quantile": quantile, "scale": _scale(of_good - of_bad)}


def rank(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): trained on labels outside the held-out fold."""
    rows = land(features(docs), "ranking-features")
    labelled = land(training_rows(rows, labels.filter(fold(F.col("doc_id"), 5) != 0)), "ranking-labelled")
    train = land(numbered(labelled), "ranking-training")
    discard(labelled)
    model = learn(train)
    discard(train)
    found = rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "x")
    schema = StructType(found.schema.fields[:2] + list(StructType.fromDDL("score double").fields))
    arrow = to_arrow_schema(schema)

    def score(batches):
        for batch in batches:
            s = utility_to_score(model, _matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), batch.column(1), pa.array(s, pa.float64())], schema=arrow)

    return found.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= F.lit(CUT)).cast("int"))
