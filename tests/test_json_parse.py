"""Strict parsing of hand-written edge lines against Python's json.loads."""
import json

from tunekiln.sources.records import parse_lines, to_samples
from tunekiln.functions import formats as fm
from pyspark.sql import functions as F

EDGE = [
    '{"instruction": "a", "output": "b"}', '{"a":1} x', '{"a":1}]', '{"a":1}}', "{'a':1}", '{"a":1,"a":2}',
    "﻿{\"a\":1}", "null", "3", "[1]", '{"messages": []}', '{"messages": "x"}',
    '{"messages": [{"content": "hi"}]}', '{"messages": [{"role": "user", "content": null}]}',
    '{"messages": [{"role": "user", "content": "q"}]}',
    '{"messages": [{"role":"user","content":"q"}], "instruction": "i", "output": "o", "conversations": [], "text": "t"}',
    '{"text": "cpt"}', '{"conversations": [{"from": "human", "value": "v"}, {"from": "bot", "value": "ans"}]}',
]


def py_status(line):
    try:
        v = json.loads(line.strip())
    except json.JSONDecodeError:
        return "bad_json"
    return "ok" if isinstance(v, dict) else "not_object"


def test_status_matches_python(spark):
    df = spark.createDataFrame([(i, l) for i, l in enumerate(EDGE)], "i int, raw string")
    got = {r.i: r.status for r in parse_lines(df).select("i", "status").collect()}
    for i, l in enumerate(EDGE):
        assert got[i] == py_status(l), l


def test_formats_and_texts(spark):
    df = spark.createDataFrame([(i, l) for i, l in enumerate(EDGE)], "i int, raw string")
    s = to_samples(parse_lines(df), keep=["i", "raw"]).filter("status = 'ok'")
    rows = {r.i: r for r in s.select("i", fm.fmt_a().alias("a"), fm.fmt_v().alias("v"),
                                     fm.full_text_a().alias("ta"), fm.output_text_a().alias("oa"),
                                     fm.tpl_auto().alias("tpl")).collect()}
    # precedence messages → instruction-output → conversations → text
    assert rows[15].v == "messages" and rows[15].a == "chat"
    assert rows[11].v == "messages" and rows[11].a == "unknown"  # messages not a list: A skips it
    assert rows[16].v == "text (CPT/pretraining)" and rows[16].a == "unknown"
    assert rows[16].ta == " " and rows[16].oa == ""  # trap 2: CPT under A
    assert rows[13].ta == ""  # null content treated as ''
    assert rows[12].tpl == "<|user|>\nhi"  # role defaults to user
    assert rows[17].oa == "ans" and rows[17].a == "conversations"
    assert rows[16].tpl is None  # unsupported for the auto template


def test_eval_prompt_for_chat_data(spark):
    from tunekiln.operators.evalset import prompt_text
    lines = ['{"messages": [{"role": "user", "content": "first"}, {"role": "assistant", "content": "a"},'
             ' {"role": "user", "content": "second"}]}']
    df = spark.createDataFrame([(0, l) for l in lines], "i int, raw string")
    s = to_samples(parse_lines(df), keep=["i"])
    r = s.select(prompt_text("messages").alias("p"), prompt_text("messages", compat=True).alias("c"),
                 fm.prompt(F.lit("messages"), prompt_text("messages")).alias("full")).collect()[0]
    assert r.p == "second" and r.c == "" and r.full == "<|user|>\nsecond\n<|assistant|>\n"


def test_split_keeps_existing_part(spark):
    from tunekiln.operators.prep import split
    rows = [("a", i, "eval" if i < 3 else "train") for i in range(20)] + [("b", i, "train") for i in range(20)]
    df = spark.createDataFrame(rows, "slice string, id long, part string")
    got = {(r.slice, r.id): r.split for r in split(df, "id", ["slice"], existing="part").collect()}
    assert sum(1 for (s, i), v in got.items() if s == "a" and v == "test") == 3
    assert all(got[("a", i)] == "test" for i in range(3))
    assert sum(1 for (s, i), v in got.items() if s == "b" and v == "test") == 2  # ceil(0.1 * 20)


def test_fuzz_against_python(spark):
    """Random near-JSON strings: the only declared difference is bare NaN / Infinity."""
    import random
    r = random.Random(3)
    atoms = ['{', '}', '[', ']', ':', ',', '"a"', '"b\\n"', '1', '-0', '1e5', '1.5E-3', 'true', 'false', 'null',
             ' ', '\t', '"\\u00e9"', '"\\ud800"', '"x\\"y"', '01', '.5', '1.', '+1', 'NaN', 'Infinity', "'a'",
             '"\x01"', '"é"', '/*c*/', '"a"}', '12345678901234567890123']
    cases = sorted({"".join(r.choice(atoms) for _ in range(r.randint(1, 8))) for _ in range(3000)})
    df = spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "i int, raw string")
    got = {row.i: row.status for row in parse_lines(df).select("i", "status").collect()}
    diff = [c for i, c in enumerate(cases) if got[i] != py_status(c)]
    assert all(("NaN" in c or "Infinity" in c) for c in diff), diff[:5]


def test_strip_prompt_quirk_and_alias_precedence(spark):
    df = spark.createDataFrame([("P:abc  answer ", "P:abc"), ("xxP:abc tail", "P:abc"), ("no prompt", "P:abc")],
                               "resp string, prompt string")
    got = [r[0] for r in df.select(fm.strip_prompt("resp", "prompt")).collect()]
    # contained anywhere → the first len(prompt) characters are dropped, then stripped
    assert got == ["answer", "bc tail", "no prompt"]
    from tunekiln.sources.records import map_aliases
    lines = ['{"instruction": "I", "prompt": "P", "completion": "C"}', '{"question": "Q", "answer": "A"}',
             '{"text": "T", "summary": "S"}', '{"input": "N", "target": "G"}']
    d = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "i int, raw string")
    rows = {r.i: (r.instruction, r.output) for r in map_aliases(parse_lines(d), keep=["i"]).collect()}
    assert rows == {0: ("I", "C"), 1: ("Q", "A"), 2: ("T", "S"), 3: ("N", "G")}


def _audit(spark, lines):
    from pyspark.sql import functions as F
    from tunekiln.operators import audit as au
    from tunekiln.sources.records import parse_lines, to_samples
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, raw string").withColumn("slice", F.lit("s"))
    s = to_samples(parse_lines(df), keep=["slice", "line_no", "raw"])
    return [(r.n_empty, r.tokens) for r in au._v_rows(s, ["slice"], "line_no").orderBy("line_no").collect()]


def test_validator_reads_typed_values(spark):
    # unknown format: an empty list is empty, a list of strings is joined, a number gives no text
    assert _audit(spark, ['{"foo": "abcd", "bar": 7, "tags": ["a", "b"], "none": []}'] * 2) == [(1, 1)] * 2
    assert _audit(spark, ['{"instruction": 5, "output": []}', '{"instruction": [], "output": {"a": 1}}']) == [(1, 0), (1, 0)]
    # messages given as a string are read as one
    assert _audit(spark, ['{"messages": "a text of more than ten"}', '{"messages": " "}', '{"messages": null}', '{"messages": []}']) == [
        (0, 6), (1, 0), (1, 0), (1, 0)]
    assert _audit(spark, ['{"text": ["ab", {"content": "cd"}, {"value": "efgh"}]}', '{"text": 3.5}']) == [(0, 2), (0, 0)]
    assert _audit(spark, ['{"a": "x", "b": null}', '{"a": ""}']) == [(1, 0), (2, 0)]


def test_bare_nan_and_infinity_are_numbers(spark):
    from tunekiln.sources.records import parse_lines
    lines = ['{"a": NaN}', '{"a": [1, -Infinity, Infinity]}', "NaN", "-Infinity", '{"a": nan}', '{"a": NaN', '{"a": "x, NaN, y"}', "[NaN]"]
    df = spark.createDataFrame(list(enumerate(lines)), "i long, raw string")
    got = [r.status for r in parse_lines(df).orderBy("i").collect()]
    assert got == ["ok", "ok", "not_object", "not_object", "bad_json", "bad_json", "ok", "not_object"]
