"""Every registered query against its DuckDB oracle on sf0.001 (as the driver does at sf0.01)."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from tunekiln import registry
from conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "score" in df.columns


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "binary": "BLOB"}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, con, name):
    sdf = registry.queries()[name](spark, SF001)
    got = sdf.toPandas()
    sql = registry.oracle_sql()[name]
    rel = con.sql(sql)
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in sdf.schema.fields:
        st = f.dataType.simpleString()
        assert TYPES.get(st, st) == types.get(f.name), (f.name, st, types.get(f.name))
    exp = rel.df()
    assert _rows(got) == _rows(exp)
