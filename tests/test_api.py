"""File-level API on real JSON-lines files equals the DataFrame fixture path."""
import re
import tempfile

from pyspark.sql import functions as F

from tunekiln import api
from tunekiln.operators import audit as au
from tunekiln.sources import fixtures as fx

from conftest import SF01


def test_validate_files_equals_frame_path(spark):
    d = tempfile.mkdtemp(prefix="run-api-", dir="/tmp")
    lines = fx.jsonl_lines(spark, SF01)
    (lines.coalesce(1).sortWithinPartitions("slice", "sample_id").select("slice", "raw")
     .write.mode("overwrite").partitionBy("slice").text(d))
    samples = api.load_jsonl(spark, d)
    v = api.validate(samples).collect()
    got = {re.search(r"slice=(src\d+)", r.slice).group(1): r for r in v}
    exp = {r.slice: r for r in au.v_audit(fx.jsonl_samples(spark, SF01), ["slice"], "line_no").collect()}
    assert set(got) == set(exp)
    for k, e in exp.items():
        g = got[k]
        assert (g.total_lines, g.valid_lines, g.invalid_lines, g.empty_count, g.dup_count, g.p95_tokens,
                g.detected_format, g.grade, g.passed) == (e.total_lines, e.valid_lines, e.invalid_lines,
                                                          e.empty_count, e.dup_count, e.p95_tokens,
                                                          e.detected_format, e.grade, e.passed)
        assert abs(g.score - e.score) < 1e-9
    a = api.analyze(samples).collect()
    assert len(a) == len(exp) and all(r.total_samples > 0 for r in a)
    t = api.training_text(samples)
    counts = {r.split: r.n for r in t.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts["test"] > 0 and counts["train"] > counts["test"]
    p = api.plan(samples).collect()
    assert len(p) == len(exp) and all(r.seq_len >= 512 for r in p)


def test_command_line_validate(spark, capsys):
    import json
    import os
    from tunekiln.__main__ import main
    d = tempfile.mkdtemp(prefix="run-cli-", dir="/tmp")
    with open(os.path.join(d, "a.jsonl"), "w") as fh:
        for i in range(120):
            fh.write(json.dumps({"instruction": f"question {i}", "output": "answer " * (i % 9 + 1)}) + "\n")
        fh.write("{broken\n")
    assert main(["validate", d]) == 0
    rows = [json.loads(l) for l in capsys.readouterr().out.strip().splitlines()]
    assert len(rows) == 1 and rows[0]["valid_lines"] == 120 and rows[0]["invalid_lines"] == 1
    assert rows[0]["detected_format"] == "instruction-output"


def test_parse_errors_without_line_shuffle(spark):
    import json
    import os
    d = tempfile.mkdtemp(prefix="run-perr-", dir="/tmp")
    expect = {}
    for f in range(2):
        lines = []
        for i in range(400):
            if i % 9 == 4:
                lines.append("   ")
            elif i % 13 == 6:
                lines.append('{"instruction": "x", "output": "y"')
            else:
                lines.append(json.dumps({"instruction": f"q{i}", "output": "a"}))
        with open(os.path.join(d, f"f{f}.jsonl"), "w") as fh:
            fh.write("\n".join(lines) + "\n")
        nb, phys, nbs = 0, [], []
        for ln, l in enumerate(lines, 1):
            if l.strip():
                nb += 1
                if l.endswith('"y"'):
                    phys.append(ln)
                    nbs.append(nb)
        expect[f"f{f}.jsonl"] = (len(phys), ",".join(map(str, phys[:3])), ",".join(map(str, nbs[:5])),
                                 ",".join(map(str, nbs[:10])))
    samples = api.load_jsonl(spark, d)
    got = {r.slice.rsplit("/", 1)[1]: (r.n_bad, r.first3_lines, r.first5_nonblank, r.first10_nonblank)
           for r in api.parse_errors(spark, d, samples).collect()}
    assert got == expect


def test_clean_dedupe_pack(spark):
    import json
    import os
    d = tempfile.mkdtemp(prefix="run-prep-", dir="/tmp")
    with open(os.path.join(d, "a.jsonl"), "w") as fh:
        for i in range(300):
            out = "" if i % 50 == 0 else ("Same answer  text" if i % 3 == 0 else f"answer number {i} " * (i % 20 + 1))
            fh.write(json.dumps({"instruction": "q" if i % 3 == 0 else f"q{i}", "output": out}) + "\n")
    samples = api.load_jsonl(spark, d)
    kept = api.clean(samples).count()
    assert kept == 300 - 6
    dd = api.dedupe(samples).collect()
    groups = {r.group_size for r in dd}
    assert len(dd) < 300 and max(groups) > 1 and sum(r.group_size for r in dd) == 300
    rows = api.training_text(samples)
    pieces = api.pack(rows, seq_len=256).collect()
    assert all(0 < p.piece_len <= 256 for p in pieces)
    total = sum(p.piece_len for p in pieces)
    from tunekiln.functions import text as tx
    exp = rows.filter("text IS NOT NULL").select(F.sum(tx.tokens_v("text") + 1)).first()[0]
    assert total == exp


def test_command_line_plan_and_prepare(spark, capsys):
    import json
    import os
    from tunekiln.__main__ import main
    d = tempfile.mkdtemp(prefix="run-cli2-", dir="/tmp")
    with open(os.path.join(d, "a.jsonl"), "w") as fh:
        for i in range(600):
            fh.write(json.dumps({"instruction": f"q{i}", "output": "answer " * (i % 30 + 1)}) + "\n")
    assert main(["plan", d, "--task", "code", "--gpu", "16"]) == 0
    plan = [json.loads(l) for l in capsys.readouterr().out.strip().splitlines()]
    assert len(plan) == 1 and plan[0]["rank"] == 8 and plan[0]["batch_size"] == 4 and plan[0]["n"] == 600
    out = tempfile.mkdtemp(prefix="run-cli3-", dir="/tmp") + "/train"
    assert main(["prepare", d, "--out", out]) == 0
    counts = {r["split"]: r["count"] for r in map(json.loads, capsys.readouterr().out.strip().splitlines())}
    assert counts == {"test": 60, "train": 540}
    assert spark.read.parquet(out).count() == 600


def test_scratch_tables_are_removed(spark):
    import os
    from tunekiln import session
    with session.scratch(spark):
        df = session.land(spark.range(5), "gone")
        path = df.inputFiles()[0].replace("file:", "").replace("//", "/").rsplit("/", 1)[0]
        assert df.count() == 5 and os.path.isdir(path)
    assert not os.path.isdir(path)
