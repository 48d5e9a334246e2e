import contextlib

import duckdb
import pytest

CLASHING = ("kept", "size", "score", "node", "n", "words", "term", "copies", "component_id", "_text", "_h", "chunk", "target", "start")


@pytest.fixture(autouse=True)
def arrow_lambdas(monkeypatch):
    """DuckDB 2 refuses the lambdas ``x -> y`` of op11's SQL unless this setting, which versions before 1.3 lack, is made."""
    connect = duckdb.connect

    def with_arrows(*args, **kwargs):
        con = connect(*args, **kwargs)
        with contextlib.suppress(duckdb.CatalogException):
            con.execute("SET lambda_syntax = 'ENABLE_SINGLE_ARROW'")
        return con

    monkeypatch.setattr(duckdb, "connect", with_arrows)


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text, lang, source, n_chars) rows to a documents table with extra columns of clashing names."""
    def make(rows, extra=True):
        base = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        if extra:
            from pyspark.sql import functions as F
            base = base.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
        return base
    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
    rows = [
        (1, "The cat sat on the mat and looked at the dog for a while today.", "en", "a", 10),
        (2, "The cat sat on the mat and looked at the dog for a while today.", "en", "a", 10),
        (2, "The cat sat on the mat and looked at the dog for a while today.", "en", "a", 10),
        (3, None, "en", "a", None), (4, "", "fr", "b", 0), (5, " \t\n ", None, "b", 4), (6, "one", "de", None, 3),
        (None, "A text without an id has ten words or a few more of them.", "en", "b", 9),
        (7, "Only two", None, None, 8), (8, long, "en", "c", len(long)), (9, "!!! ### $$$", "en", "c", 11),
        (10, "你好 世界", "zh", "c", 5), (11, None, None, None, None),
    ]
    return rows
