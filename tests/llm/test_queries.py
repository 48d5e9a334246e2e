"""Registered queries on sf0.001: shape, oracle where there is one, and tables without rows."""
import duckdb
import pytest
from conftest import SF001

import __spark_entry__ as E

OPS = sorted(q for q in E.queries() if q.startswith("op") and q[2].isdigit())
BY_DOCUMENT = [q for q in OPS if not q.startswith("op11_")]


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in OPS) == list(range(1, 14))
    assert "pipeline" in E.queries()


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_one_row_per_document(spark, name):
    got = E.queries()[name](spark, SF001)
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == spark.read.parquet(f"{SF001}/documents.parquet").count() == len(set(ids))
    if name in E.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "benchmark", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
        want = con.sql(E.oracle_sql()[name])
        assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
