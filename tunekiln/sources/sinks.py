"""Sinks: audit reports, training text, eval results, JSON lines. All writes are distributed
(one file per task, partitioned by the listed columns); nothing passes through the driver. Reports, training text and
eval results are published as a whole (``publish``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .publish import publish, read_published

REPORT_SCHEMA = (
    "slice string, passed boolean, "
    "stats struct<total_lines:bigint, valid_lines:bigint, invalid_lines:bigint, detected_format:string, "
    "key_fields:array<string>, empty_count:bigint, dup_count:bigint, total_duplicates:bigint, avg_tokens:double, "
    "p50_tokens:bigint, p95_tokens:bigint, p99_tokens:bigint, score:double, grade:string>, "
    "issues array<string>, advice string, "
    "length struct<min:bigint, max:bigint, mean:double, median:double, percentile_80:bigint, percentile_95:bigint, "
    "total_samples:bigint, estimated_p95_tokens:bigint, estimated_median_tokens:double>, "
    "quality struct<has_issues:boolean, issues:array<string>, empty_output_ratio:double, duplicate_ratio:double, "
    "bilingual_ratio:double>, "
    "format struct<format:string, fields:array<string>>"
)
EVAL_SCHEMA = ("item_id bigint, instruction string, formatted_prompt string, expected string, "
               "base_model_output string, lora_model_output string")


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document per slice (``operators.audit.audit_report``): length, quality, format,
    passed, stats (floats to 1 decimal), issues, advice. One file per task."""
    publish(report, path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return read_published(spark, path, schema=REPORT_SCHEMA)


def write_train(rows: DataFrame, path: str) -> None:
    """Formatted training rows, partitioned by split (and slice) for partition pruning."""
    publish(rows, path, "parquet", ["split"])


def read_train(spark: SparkSession, path: str) -> DataFrame:
    return read_published(spark, path, "parquet")


def write_eval(rows: DataFrame, path: str) -> None:
    publish(rows, path)


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    return read_published(spark, path, schema=EVAL_SCHEMA)


def write_jsonl_lines(lines: DataFrame, path: str) -> None:
    """Lines as text files, one directory per slice, lines in sample order inside each file.
    Range partitioning on (slice, sample_id) splits a large slice over many tasks and files."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (lines.repartitionByRange(n, "slice", "sample_id").sortWithinPartitions("slice", "sample_id")
     .select("slice", "raw").write.mode("overwrite").partitionBy("slice").text(path))


def write_text(df: DataFrame, col: str, path: str) -> None:
    df.select(F.col(col)).write.mode("overwrite").text(path)
