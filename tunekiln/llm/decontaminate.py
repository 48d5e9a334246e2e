"""Benchmark decontamination with a distributed positional inverted index. DataFrame functions only.

Test items are cut into windows of WINDOW words (shorter items are one window). A first pass counts the
test terms in the training texts; windows with an absent term cannot occur. Each remaining window is looked
up by its two rarest terms: the index stores the postings (term, document, position) of these terms, with
the words around each posting. The two lists, moved by the terms' offsets in the window, are intersected on
(document, window, start); the context then proves the phrase exactly. ``proximity`` intersects the same
lists with a tolerance instead.

Training texts are never shuffled: they meet the test terms as broadcast blocks of at most BLOCK_TERMS
terms, one pass for each block. Postings of rare terms, matches and one row per document are what moves.
A row is known by its id and a hash of its text, so repeated rows share their postings and each gets the
result.

Defined cases: null and empty texts have no words, no hits and are clean; items without words have no
windows; items without an id are ignored; an empty benchmark leaves all documents clean; an empty table
gives an empty result; repeated items count once by id; other columns are ignored, or passed through by
``keep_documents``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, land, words_of

WINDOW = 13
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BLOCK_TERMS = 200_000
SHARE = 20  # contaminated where SHARE * n_hit >= n_words


def tokens(df: DataFrame, key: str) -> DataFrame:
    """(key, _h, words) of whole texts."""
    text = F.col("text").cast("string")
    return df.select(key, F.xxhash64(text).alias("_h"), words_of(ascii_lower(text), SEPARATORS).alias("words"))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, words): distinct windows of the items."""
    n = F.size("words")
    k = F.least(n, F.lit(size))
    t = tokens(items, "item_id").filter(F.col("item_id").isNotNull() & (n > 0))
    starts = F.sequence(F.lit(1), n - k + 1)
    return t.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, k))).alias("words")).distinct()


def _in_blocks(docs: DataFrame, terms: DataFrame, per_block) -> DataFrame:
    """Union of ``per_block(docs, broadcast terms)`` over blocks of at most about BLOCK_TERMS terms."""
    blocks = -(-terms.count() // BLOCK_TERMS) or 1
    part = F.pmod(F.xxhash64("term"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [per_block(docs, F.broadcast(terms.filter(part == b) if blocks > 1 else terms)) for b in range(blocks)])


def rarest(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(wid, item_id, words, term1, at1, term2, at2): windows whose terms all occur, with their two rarest
    terms and the 0-based places of these (term2 is null in windows of one word)."""
    wins = land(wins.withColumn("wid", F.xxhash64("item_id", "words")), "decon-windows")
    vocabulary = land(wins.select(F.explode("words").alias("term")).distinct(), "decon-terms")
    found = _in_blocks(docs, vocabulary, lambda d, t: d.select(F.explode("words").alias("term")).join(t, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    counts = land(found, "decon-counts")
    places = wins.select("wid", "item_id", "words", F.posexplode("words").alias("at", "term")).join(counts, "term")
    order = F.array_sort(F.collect_list(F.struct("n", "at", "term")))
    picked = places.groupBy("wid", "item_id", "words").agg(order.alias("o")).filter(F.size("o") == F.size("words"))
    first, second = F.col("o")[0], F.get(F.col("o"), F.lit(1))
    return picked.select("wid", "item_id", "words", first["term"].alias("term1"), first["at"].alias("at1"),
                         second["term"].alias("term2"), second["at"].alias("at2"))


def build_index(docs: DataFrame, terms: DataFrame, around: int = WINDOW - 1) -> DataFrame:
    """Stored postings (term, doc_id, _h, pos, context, context_at) of ``terms``: 0-based positions, the
    words from ``context_at`` on up to ``around`` words on either side."""
    def postings(d, t):
        p = d.select("doc_id", "_h", "words", F.posexplode("words").alias("pos", "term")).join(t, "term")
        at = F.greatest(F.col("pos") - around, F.lit(0))
        return p.select("term", "doc_id", "_h", "pos", F.slice("words", at + 1, F.lit(2 * around + 1)).alias("context"), at.alias("context_at"))

    return land(_in_blocks(docs, terms, postings), "decon-index")


def _lists(index: DataFrame, wins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of the rarest and of the second rarest term, moved to the window's start."""
    one = index.join(wins.select("wid", "item_id", F.size("words").alias("k"), F.col("words").alias("phrase"), F.col("term1").alias("term"), "at1"), "term")
    one = one.select("doc_id", "_h", "wid", "item_id", "k", "phrase", (F.col("pos") - F.col("at1")).alias("start"), "context", "context_at", "term")
    two = index.drop("context", "context_at").join(wins.select("wid", F.col("term2").alias("term"), "at2"), "term")
    return one, two.select("doc_id", "_h", "wid", (F.col("pos") - F.col("at2")).alias("start"))


def _same(a: str, b: str):
    return (F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._h") == F.col(f"{b}._h")) & (F.col(f"{a}.wid") == F.col(f"{b}.wid")))


def phrases(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, _h, item_id, start, k): every occurrence of every window; start is a 0-based word."""
    t = tokens(docs, "doc_id")
    wins = land(rarest(t, windows(items, size)), "decon-picked")
    terms = land(wins.select(F.explode(F.array("term1", "term2")).alias("term")).filter("term is not null").distinct(), "decon-pivots")
    one, two = _lists(build_index(t, terms, size - 1), wins)
    met = one.alias("a").join(two.alias("b"), _same("a", "b") & (F.col("a.start") == F.col("b.start")), "left_semi")
    alone = one.filter("k = 1")
    place = F.col("start") - F.col("context_at") + 1
    # the context proves the phrase, the intersection only proposes it
    return (met.unionByName(alone).filter("start >= 0")
            .filter(F.slice("context", F.greatest(place, F.lit(1)), F.col("k")) == F.col("phrase"))
            .select("doc_id", "_h", "item_id", "start", "k").distinct())


def proximity(docs: DataFrame, items: DataFrame, slop: int = 5, size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, start): windows whose two rarest terms stand at their distance in the text, give
    or take ``slop`` words."""
    t = tokens(docs, "doc_id")
    wins = land(rarest(t, windows(items, size)), "decon-picked")
    terms = land(wins.select(F.explode(F.array("term1", "term2")).alias("term")).filter("term is not null").distinct(), "decon-pivots")
    one, two = _lists(build_index(t, terms, size - 1), wins)
    near = F.abs(F.col("a.start") - F.col("b.start")) <= slop
    return one.alias("a").join(two.alias("b"), _same("a", "b") & near, "left_semi").select("doc_id", "item_id", "start").distinct()


def hits(found: DataFrame) -> DataFrame:
    """(doc_id, _h, n_hit, items): words inside any occurrence, and the ids of the items that occur."""
    by = ["doc_id", "_h"]
    spans = found.select(*by, "start", (F.col("start") + F.col("k")).alias("end")).distinct()
    before = F.max("end").over(Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce("_before", F.lit(0))))
    n_hit = spans.withColumn("_before", before).groupBy(*by).agg(F.sum(fresh).cast("bigint").alias("n_hit"))
    items = found.select(*by, F.col("item_id").cast("string").alias("item")).distinct().groupBy(*by).agg(F.array_sort(F.collect_list("item")).alias("items"))
    a, b = n_hit.alias("a"), items.alias("b")
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._h") == F.col("b._h"))).select("a.*", "b.items")


def _contaminated(n_hit, n_words):
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``."""
    found = land(hits(land(phrases(docs, items, size), "decon-phrases")), "decon-hits").select(
        F.col("doc_id").alias("_id"), F.col("_h").alias("_hh"), "n_hit", "items")
    rows = tokens(docs, "doc_id").select("doc_id", "_h", F.size("words").cast("bigint").alias("n_words"))
    j = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (rows["_h"] == found["_hh"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return j.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
                    F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), _contaminated(n_hit, F.col("n_words")).alias("contaminated"))


def keep_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    found = hits(land(phrases(docs, items, size), "decon-phrases"))
    n = tokens(docs, "doc_id").select(F.col("doc_id").alias("_id"), F.col("_h").alias("_hh"), F.size("words").alias("n_words"))
    # the few rows with hits meet their word counts; then one anti-join on them
    bad = found.join(n, found["doc_id"].eqNullSafe(n["_id"]) & (found["_h"] == n["_hh"])).filter(_contaminated(F.col("n_hit"), F.col("n_words")))
    bad = land(bad.select("_id", "_hh").distinct(), "decon-bad")
    text = docs["text"].cast("string")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(text) == bad["_hh"]), "left_anti")


ORACLE = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS p
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS p
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, s, dw.k AS k FROM dw JOIN win ON dw.k = win.k AND dw.p = win.p),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
