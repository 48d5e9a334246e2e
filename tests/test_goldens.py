"""Known values at sf0.01 on the whole documents table and conversations."""
from pyspark.sql import functions as F

from tunekiln.operators import audit as au
from tunekiln.sources import fixtures as fx

from conftest import SF01


def test_documents_v_golden(spark):
    d = fx.text_records(spark, SF01).withColumn("slice", F.lit("all"))
    r = au.v_audit(d, ["slice"], "sample_id").collect()[0]
    assert r.valid_lines == 1000
    assert round(r.avg_tokens, 3) == 722.503
    assert (r.p50_tokens, r.p95_tokens, r.p99_tokens) == (442, 2220, 4190)
    assert (r.dup_count, r.total_duplicates, r.empty_count) == (71, 85, 0)
    assert int(r.score) == 83 and r.grade == "Good" and r.passed


def test_conversations_goldens(spark):
    m = fx.messages_records(spark, SF01)
    v = au.v_audit(m, ["slice"], "sample_id").collect()[0]
    assert v.valid_lines == 100 and round(v.avg_tokens, 2) == 849.22
    assert (v.p50_tokens, v.p95_tokens, v.p99_tokens) == (838, 1535, 1817) and int(v.score) == 95
    a = au.length_stats(m, ["slice"]).collect()[0]
    assert (a.min_chars, a.max_chars, a.mean_chars, a.median_chars, a.p80_chars, a.p95_chars) == (
        201, 6066, 2836.6, 2799.0, 3894, 5020)
    assert (a.p95_tokens_est, a.median_tokens_est) == (1506, 839.7)
    q = au.quality_a(m, ["slice"]).collect()[0]
    assert q.short_count == 2 and q.bilingual_count == 0


def test_pairs_goldens(spark):
    p = fx.pair_records(spark, SF01)
    v = au.v_audit(p, ["slice"], "sample_id").collect()[0]
    assert v.valid_lines == 233 and round(v.avg_tokens, 6) == 347.892704
    assert (v.p50_tokens, v.p95_tokens, v.p99_tokens) == (344, 581, 610) and int(v.score) == 95
    a = au.length_stats(p, ["slice"]).collect()[0]
    assert (a.min_chars, a.max_chars, a.mean_chars, a.median_chars, a.p80_chars, a.p95_chars) == (
        155, 2165, 1162.2, 1150.0, 1676, 1934)
    assert (a.p95_tokens_est, a.median_tokens_est) == (580, 345.0)


def test_documents_raw_dups(spark):
    d = fx.table(spark, SF01, "documents").select(F.lit("all").alias("slice"), F.unhex(F.md5("text")).alias("k"))
    assert au.exact_dups(d, ["slice"], "k").collect()[0].duplicate_count == 73
