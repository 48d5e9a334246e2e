"""Command line: ``python -m tunekiln <command> <path> [options]``.

Commands mirror the file-level API: ``validate`` (V report), ``analyze`` (A report), ``report``
(both, optionally written as JSON), ``plan`` (training plan) and ``prepare`` (templated, split
training rows written as Parquet partitioned by split). Per-file results are written as JSON to
``--out``, or without it printed one by one; they never stand in the driver together.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tunekiln")
    p.add_argument("command", choices=["validate", "analyze", "report", "plan", "prepare"])
    p.add_argument("path", help="JSON-lines file, folder or glob")
    p.add_argument("--out", help="output folder (per-file results as JSON; prepare: Parquet)")
    p.add_argument("--task", default="chat", choices=["chat", "code", "math", "roleplay", "cpt"])
    p.add_argument("--model", default="qwen2-7b")
    p.add_argument("--gpu", type=float, default=24.0, help="card memory in GB")
    p.add_argument("--master", default=None, help="Spark master for a local run (default: existing session)")
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession

    from . import api
    from .session import get_session, prepare, scratch
    from .sources.publish import publish, replace
    spark = get_session(a.master) if a.master else prepare(SparkSession.builder.getOrCreate())
    if a.command == "prepare" and not a.out:
        p.error("prepare needs --out")
    with scratch(spark):
        samples = api.load_jsonl(spark, a.path)
        if a.command == "validate":
            out = api.validate(samples)
        elif a.command == "analyze":
            out = api.analyze(samples)
        elif a.command == "report":
            out = api.report(samples, a.out)
        elif a.command == "plan":
            out = api.plan(samples, task=a.task, model=a.model, gpu_gb=a.gpu)
        else:
            rows = api.training_text(samples)
            replace(rows, a.out, "parquet", ["split"])  # plain Parquet, which any reader finds
            out = rows.groupBy("slice", "split").count()
        if a.out and a.command in ("validate", "analyze", "plan"):
            publish(out, a.out)
        else:
            for line in out.toJSON().toLocalIterator():
                print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
