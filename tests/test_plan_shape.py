"""Scale shape of the physical plans: no Python UDFs in the core, bounded top-k, broadcasts."""
from conftest import SF001

from tunekiln import registry
from tunekiln.operators import audit as au
from tunekiln.sources import fixtures as fx

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_batch_queries(spark):
    for name, fn in registry.queries().items():
        if name.startswith("str_"):
            continue
        p = _plan(fn(spark, SF001))
        assert not any(n in p for n in PYTHON_NODES), name


def test_top_k_uses_group_limit(spark):
    p = _plan(registry.queries()["top_samples"](spark, SF001))
    assert "WindowGroupLimit" in p


def test_validator_rows_move_no_text(spark):
    samples = fx.text_records(spark, SF001)
    for rows in (au._v_rows(samples, ["slice"], "sample_id"), au.t_rows(samples, ["slice"], "sample_id")):
        p = _plan(rows)
        assert "BroadcastHashJoin" in p
        assert not any(x in p for x in ("Exchange hashpartitioning", "SortMergeJoin", "SortAggregate", "Sort ["))


def test_many_slices_are_salted_not_broadcast(spark, monkeypatch):
    samples = fx.text_records(spark, SF001)
    want = sorted(map(tuple, au._v_rows(samples, ["slice"], "sample_id").collect()), key=repr)
    monkeypatch.setattr(au, "SLICE_BROADCAST_ROWS", 1)
    rows = au._v_rows(samples, ["slice"], "sample_id")
    assert "_salt" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, rows.collect()), key=repr) == want


def test_score_reads_the_landed_pass(spark):
    df = registry.queries()["agg_score_v"](spark, SF001)
    df.collect()
    p = _plan(df)
    # the text rules ran once, into the landed GROUPING SETS table; the final plan reads it
    assert "FileScan parquet" in p and "regexp_count" not in p and "translate" not in p


def test_scans_read_only_needed_columns(spark):
    p = _plan(registry.queries()["flt_over_length"](spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
    p = _plan(registry.queries()["log_run_summary"](spark, SF001))
    assert "props" not in p  # the events scan skips the unused text column
