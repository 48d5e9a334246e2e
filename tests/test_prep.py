"""Invariants of split, pack and dedupe, and traps 3 and 7."""
import json
import math
import re

from pyspark.sql import functions as F

from tunekiln.functions import formats as fm
from tunekiln.operators import audit as au
from tunekiln.operators import prep
from tunekiln.sources.records import parse_lines, to_samples


def test_split_exact_counts(spark):
    sizes = [1, 2, 9, 10, 11, 29, 30, 31, 99, 100, 101, 999, 1000, 4321]
    rows = [(f"s{n}", i) for n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "slice string, id long")
    got = {r.slice: r.n for r in prep.split(df, "id", ["slice"]).filter("split = 'test'")
           .groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    for n in sizes:
        assert got.get(f"s{n}", 0) == math.ceil(0.1 * n), n
    # the chosen rows are the smallest md5('42|id') digests
    import hashlib
    test_ids = {r.id for r in prep.split(df.filter("slice = 's4321'"), "id", ["slice"]).filter("split = 'test'").collect()}
    ranked = sorted(range(4321), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    assert test_ids == set(ranked[:math.ceil(0.1 * 4321)])


def test_pack_invariants(spark):
    rows = [(i, (i * 37) % 900 + (5000 if i % 97 == 0 else 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, tokens long")
    seq = 1024
    pieces = prep.pack(df, "id", "tokens", seq, prep.range_shard("id", 700)).collect()
    assert {p.shard for p in pieces} == set(range(math.ceil(3000 / 700)))
    # more rows leave the packs of the other ranges as they are
    more = df.unionByName(spark.createDataFrame([(9000, 5)], "id long, tokens long"))
    again = prep.pack(more, "id", "tokens", seq, prep.range_shard("id", 700)).filter("sample_id <> 9000").collect()
    assert sorted(again) == sorted(pieces)
    by_sample = {}
    for p in pieces:
        assert 0 < p.piece_len <= seq and 0 <= p.pack_offset and p.pack_offset + p.piece_len <= seq
        by_sample.setdefault(p.sample_id, []).append(p)
    assert len(by_sample) == 3000
    for sid, ps in by_sample.items():
        ps.sort(key=lambda p: p.piece_start)
        assert sum(p.piece_len for p in ps) == ps[0].sample_len == dict(rows)[sid] + 1
        for a, b in zip(ps, ps[1:]):  # pieces continue in the next pack at offset 0
            assert a.piece_start + a.piece_len == b.piece_start and b.pack == a.pack + 1 and b.pack_offset == 0
    used = {}
    for p in pieces:
        used[(p.shard, p.pack)] = used.get((p.shard, p.pack), 0) + p.piece_len
    full = {k for k, v in used.items() if v == seq}
    assert all(p.is_full == ((p.shard, p.pack) in full) for p in pieces)


def test_keep_first_hot_key(spark):
    rows = [(i, "" if i % 3 else f"t{i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, t string")
    k = prep.keep_first(df, "t", "id").collect()
    got = {r.t: (r.id, r.group_size) for r in k}
    assert got[""] == (1, 2000)
    assert got["t0"] == (0, sum(1 for i in range(3000) if i % 3 == 0 and i % 50 == 0))


def _samples(spark, recs):
    lines = [json.dumps(r) for r in recs]
    df = spark.createDataFrame([(i + 1, l) for i, l in enumerate(lines)], "line_no long, raw string")
    return to_samples(parse_lines(df.withColumn("slice", F.lit("s"))), keep=["slice", "line_no", "raw"])


def test_trap3_control_chars_only_in_instruction(spark):
    s = _samples(spark, [{"messages": [{"role": "user", "content": "a\tb"}, {"role": "assistant", "content": "c\rd"}]},
                         {"instruction": "x\ty", "output": "fine output"}])
    q = au.quality_a(s, ["slice"]).collect()[0]
    assert q.control_count == 1


def test_trap7_input_detected_and_ignored(spark):
    s = _samples(spark, [{"instruction": "abc", "input": "IGNORED", "output": "def"}])
    f = au.first_records(s, ["slice"], "line_no").collect()[0]
    assert f.fmt_v == "instruction-output"
    kf = s.select(fm.key_fields_v(F.lit("instruction-output")).alias("k"),
                  fm.full_text_v(F.lit("instruction-output")).alias("t"), F.col("k_input")).collect()[0]
    assert kf.k == ["instruction", "output"] and kf.t == "abcdef" and kf.k_input


def test_length_stats_match_numpy(spark):
    import numpy as np
    import random
    from tunekiln.sources.records import samples_from_columns
    r = random.Random(11)
    rows = []
    for s in range(6):
        n = r.choice([1, 2, 3, 7, 50, 101, 640])
        for i in range(n):
            body = "".join(r.choice("ab 中가ア") for _ in range(r.randint(0, 300)))
            rows.append((f"s{s}", i, body, "x" * r.randint(0, 9)))
    df = spark.createDataFrame(rows, "slice string, sample_id long, instruction string, output string")
    samples = samples_from_columns(df, instruction="instruction", output="output", keep=["slice", "sample_id"])
    got = {row.slice: row for row in au.length_stats(samples, ["slice"]).collect()}
    cjk = re.compile(r"[一-鿿㐀-䶿぀-ヿ가-힯\U00020000-\U0002a6df]")
    for s in {x[0] for x in rows}:
        texts = [a + " " + b for (sl, _, a, b) in rows if sl == s]
        chars = np.array([len(t) for t in texts])
        toks = np.array([len(cjk.findall(t)) * 2.0 + (len(t) - len(cjk.findall(t))) * 0.3 for t in texts])
        g = got[s]
        assert (g.min_chars, g.max_chars) == (int(chars.min()), int(chars.max()))
        assert g.mean_chars == float(round(np.mean(chars), 1))
        assert g.median_chars == float(round(np.median(chars), 1))
        assert (g.p80_chars, g.p95_chars) == (int(np.percentile(chars, 80)), int(np.percentile(chars, 95)))
        assert g.p95_tokens_est == int(np.percentile(toks, 95))
        assert g.median_tokens_est == float(round(np.median(toks), 1))


def test_clean_keeps_every_format(spark):
    recs = [{"messages": [{"role": "user", "content": "hello"}, {"role": "assistant", "content": "a full reply"}]},
            {"conversations": [{"from": "user", "value": "hello"}, {"from": "bot", "value": "a full reply"}]},
            {"text": "some text"}, {"instruction": "do it", "output": "a full reply"}, {"foo": "bar"},
            {"messages": []}, {"text": " "}, {"instruction": "do it", "output": "ok"}, {"foo": " "}]
    got = [r.line_no for r in prep.clean(_samples(spark, recs)).orderBy("line_no").collect()]
    assert got == [1, 2, 3, 4, 5]
    assert prep.clean(_samples(spark, [{"text": "word " * 5000}])).count() == 1
    assert prep.clean(_samples(spark, [{"text": "word " * 5000}]), 2048).count() == 0


def test_dedupe_merges_whole_texts_only(spark):
    from tunekiln import api
    head = "x" * 300
    recs = [{"text": head + " one"}, {"text": head + " two"}, {"text": head.upper() + "  ONE"}, {"foo": "a"}, {"bar": "a"},
            {"foo": "a"}, [1], [2], {"messages": []}, {"messages": [], "id": 2}]
    got = [(r.line_no, r.group_size) for r in api.dedupe(_samples(spark, recs)).orderBy("line_no").collect()]
    assert got == [(1, 2), (2, 1), (4, 2), (5, 1), (7, 1), (8, 1), (9, 1), (10, 1)]


def test_trap_text_records_have_no_text_for_the_analyzer(spark):
    s = _samples(spark, [{"text": "a long text of a training corpus"}])
    row = au.a_rows(s, ["slice"]).collect()[0]
    assert row.chars == 1 and abs(row.tokens_f - 0.3) < 1e-12


def test_packs_keep_slice_and_id(spark):
    from tunekiln import api
    df = spark.createDataFrame([(s, i, "word " * (i % 40 + 1)) for s in "ab" for i in range(100)], "slice string, line_no long, text string")
    pieces = api.pack(df, 64, ids_per_shard=30).collect()
    assert {(p.slice, p.line_no) for p in pieces} == {(s, i) for s in "ab" for i in range(100)}
    assert {p.shard for p in pieces} == {0, 1, 2, 3}
