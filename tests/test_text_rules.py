"""Differential tests: Spark column rules against plain-Python versions written from the rule text."""
import json
import random
import re

from pyspark.sql import functions as F

from tunekiln.functions import text as tx

CJK_AV = re.compile(r"[一-鿿㐀-䶿぀-ヿ가-힯\U00020000-\U0002a6df]")
CJK_T = re.compile(r"[一-鿿㐀-䶿]")
ALPHABET = ("abcXYZ 019.,\t\r\n\x0b\x0c\x1c\x1f\x85\xa0       　"
            "一鿿㐀䶿ぁヿ가힯\U00020000\U0002a6df\U0001F600éß\x00")


def py_tokens(t, rx):
    c = len(rx.findall(t))
    return c * 2.0 + (len(t) - c) * 0.3


def random_texts(n=300, seed=7):
    r = random.Random(seed)
    out = ["", " ", "　 ", "Von.", "x" * 205]
    for _ in range(n):
        out.append("".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))))
    return out


def test_text_rules_match_python(spark):
    texts = random_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(
        "i", tx.char_len("t").alias("n"), tx.cjk_count("t").alias("c"), tx.cjk_count_t("t").alias("ct"),
        tx.tokens_a("t").alias("ta"), tx.tokens_v("t").alias("tv"), tx.tokens_t("t").alias("tt"),
        tx.py_strip("t").alias("s"), tx.fingerprint("t").alias("fp"), tx.is_short_output("t").alias("short"),
        tx.has_control("t").alias("ctl"), tx.is_bilingual("t").alias("bi"),
    ).orderBy("i").collect()
    for r in rows:
        t = texts[r.i]
        assert r.n == len(t)
        assert r.c == len(CJK_AV.findall(t))
        assert r.ct == len(CJK_T.findall(t))
        assert r.ta == py_tokens(t, CJK_AV)
        assert r.tv == int(py_tokens(t, CJK_AV))
        assert r.tt == int(py_tokens(t, CJK_T))
        assert r.s == t.strip(), repr(t)
        # Java and Python lower-case agree on this alphabet except the sharp s / dotted I family
        assert r.fp == "".join(t.lower().split())[:200], repr(t)
        assert r.short == (len(t.strip()) < 5)
        assert r.ctl == any(c in t for c in ["\t", "\r", "\x00"])
        assert r.bi == (any("一" <= c <= "鿿" for c in t) and any(c.isascii() and c.isalpha() for c in t))


def test_round_even_and_seq_len(spark):
    df = spark.createDataFrame([(12.25,), (0.125,), (2.5,), (3.5,)], "x double")
    got = [r[0] for r in df.select(tx.round_even("x", 1)).collect()]
    assert got == [12.2, 0.1, 2.5, 3.5]
    p = spark.createDataFrame([(0,), (511,), (512,), (8191,), (8192,), (20000,)], "p long")
    got = [r[0] for r in p.select(tx.seq_len_from_p95("p")).collect()]
    exp = []
    for v in [0, 511, 512, 8191, 8192, 20000]:
        s = max(512, ((v // 512) + 1) * 512)
        exp.append(min(s, 16384) if s > 8192 else s)
    assert got == exp
