"""Rows whose slice, run or language is null are a group of their own in every per-slice operator."""
import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from test_oracle import TABLES, _rows
from tunekiln import registry
from tunekiln.functions.joins import join_on
from tunekiln.operators import audit as au
from tunekiln.operators import prep
from tunekiln.plans import corpus_plan as pl
from tunekiln.sources.lines import number_rows
from tunekiln.sources.records import samples_from_columns

REPLACED = {
    "documents": "* REPLACE (CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS source, CASE WHEN doc_id % 6 = 1 THEN NULL ELSE lang END AS lang)",
    "events": "* REPLACE (CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS user_id)",
}
NAMES = ["src_jsonl_lines", "src_json_parse", "src_parse_errors", "snk_audit_report", "prj_full_text_t", "agg_format_mix", "agg_score_v",
         "agg_length_stats", "agg_quality_level", "agg_exact_dups", "jn_dup_members", "jn_overrides", "win_keep_first", "win_split",
         "plan_seq_len", "plan_full", "plan_match_models", "log_run_summary", "log_loss_spike"]


@pytest.fixture(scope="module")
def null_dir(tmp_path_factory):
    out = tmp_path_factory.mktemp("nulls")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"COPY (SELECT {REPLACED.get(t, '*')} FROM '{SF001}/{t}.parquet') TO '{out}/{t}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle_with_null_slices(spark, null_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{null_dir}/{t}.parquet')")
    got, want = registry.queries()[name](spark, null_dir).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert _rows(got) == _rows(want)


@pytest.fixture(scope="module")
def sixty(spark):
    rows = [(i, [None, "a", "b"][i % 3], f"text number {i // 2} of a slice") for i in range(60)]
    return spark.createDataFrame(rows, "sample_id bigint, slice string, text string")


def test_operators_keep_all_rows(sixty):
    numbered = number_rows(sixty, "sample_id", by=["slice"], out="n").collect()
    assert sorted((str(r.slice), r.n) for r in numbered) == sorted((str(s), k) for s in (None, "a", "b") for k in range(1, 21))
    kept = prep.keep_first(sixty, F.col("sample_id"), "sample_id", ["slice"])
    assert kept.count() == 60
    parts = {(r.slice, r.split): r["count"] for r in prep.split(sixty, "sample_id", ["slice"]).groupBy("slice", "split").count().collect()}
    assert parts == {(s, p): n for s in (None, "a", "b") for p, n in (("train", 18), ("test", 2))}
    given = sixty.withColumn("part", F.when(F.col("slice").isNull() & (F.col("sample_id") < 9), "eval").otherwise("train"))
    held = {(r.slice, r.split): r["count"] for r in prep.split(given, "sample_id", ["slice"], existing="part").groupBy("slice", "split").count().collect()}
    assert held[(None, "test")] == 3 and held[("a", "test")] == 2 and sum(held.values()) == 60


def test_audit_scores_the_null_slice_as_the_others(sixty):
    s = samples_from_columns(sixty, text="text", keep=["slice", "sample_id"])
    v = {r.slice: r for r in au.v_audit(s, ["slice"], "sample_id").collect()}
    assert len({(r.score, r.grade, r.valid_lines, r.p95_tokens) for r in v.values()}) == 1 and set(v) == {None, "a", "b"}
    assert {r.slice for r in au.length_stats(s, ["slice"]).collect()} == {None, "a", "b"}
    assert {r.slice for r in pl.seq_len_plan(s, ["slice"]).collect()} == {None, "a", "b"}


def test_no_score_without_statistics(spark):
    row = spark.createDataFrame([("x", 50, 0, 0, 0, 0, None, None), ("y", 0, 3, 0, 0, 0, None, None)],
                                "slice string, valid_lines long, invalid_lines long, empty_count long, dup_count long, total_duplicates long, "
                                "p95_tokens long, avg_tokens double")
    got = {r.slice: (r.score, r.grade, r.passed) for r in au.score_v(row).collect()}
    assert got == {"x": (None, None, False), "y": (0.0, "Unusable", False)}


def test_many_slices_are_joined_with_salt(spark, sixty, monkeypatch):
    monkeypatch.setattr(au, "SLICE_BROADCAST_ROWS", 0)
    small = sixty.groupBy("slice").agg(F.count(F.lit(1)).alias("c"))
    assert sorted(str(r.slice) for r in au.attach_small(sixty, small, ["slice"]).filter("c = 20").collect()) == sorted(["None", "a", "b"] * 20)


def test_repeated_keys_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1, "x"), (None, 1, "y"), ("a", 2, "z"), ("a", None, "w"), ("a", 3, "v")], "g string, k int, t string")
    got = number_rows(df, "k", by=["g"], out="n", buckets=2).collect()
    assert sorted((str(r.g), r.n) for r in got) == [("None", 1), ("None", 2), ("a", 1), ("a", 2), ("a", 3)]
    assert {r.t: r.n for r in got if r.g} == {"w": 1, "z": 2, "v": 3}
    both = join_on(df, df.groupBy("g", "k").agg(F.count(F.lit(1)).alias("c")), ["g", "k"], "left")
    assert both.columns == ["g", "k", "t", "c"] and both.filter("c is null").count() == 0
