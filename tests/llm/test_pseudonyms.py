import hashlib
import re

from pyspark.sql import functions as F

from tunekiln.llm import pseudonyms as P


def feistel(left, right, mod_left, mod_right, tweak, key):
    """The rounds in plain Python."""
    for i in range(1, P.ROUNDS + 1):
        noise = lambda x: int(hashlib.sha256(f"{key}|{tweak}|{i}|{x}|{key}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            right = (right + noise(left) % mod_right) % mod_right
        else:
            left = (left + noise(right) % mod_left) % mod_left
    return left, right


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - (9 if d > 4 else 0) for i, d in enumerate(map(int, reversed(digits)))) % 10


def card(digits, key):
    body = digits[:-1]
    u = len(body) // 2
    left, right = feistel(int(body[:u]), int(body[u:]), 10 ** u, 10 ** (len(body) - u), f"card{len(body)}", key)
    body = f"{left:0{u}d}{right:0{len(body) - u}d}"
    return body + str((10 - luhn(body + "0")) % 10)


def valid_cards(n):
    out = []
    for i in range(n):
        body = str(4000000000000 + i * 7919)[: 12 + i % 7]
        out.append(body + str((10 - luhn(body + "0")) % 10))
    return out


def test_cards_against_plain_python(make_docs):
    cards = valid_cards(60)
    rows = P.mask(make_docs([(i, f"pay {c} now", None, None, None) for i, c in enumerate(cards)]), "k1").collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    for i, c in enumerate(cards):
        if luhn(c) == 0 and len(c) >= 13:
            assert got[i] == f"pay {card(c, 'k1')} now" and luhn(card(c, "k1")) == 0


def test_equal_values_stay_linked_and_restore(make_docs):
    values = ["4111 1111 1111 1111", "+1 (017) 555-7713", "97.51.17.173", "2024-02-29", "31/12/1999"]
    docs = make_docs([(i, f"first {v}, again {v}.\n" + "end", None, None, None) for i, v in enumerate(values)] * 2)
    masked = P.mask_documents(docs, "secret")
    rows = masked.collect()
    assert masked.columns == docs.columns and len({r["text"] for r in rows}) == len(values)
    for r in rows:
        old = values[r["doc_id"]]
        a, b = re.fullmatch(r"first (.*), again (.*)\.\nend", r["text"]).groups()
        assert a == b != old and old not in r["text"]
        if "." not in old:  # bytes of an address vary in length
            assert re.sub("[0-9]", "9", a) == re.sub("[0-9]", "9", old)
    assert sorted(r["text"] for r in P.restore(masked, "secret").collect()) == sorted(r["text"] for r in docs.collect())
    assert P.restore(masked, "other").filter(F.col("text").contains("4111 1111 1111 1111")).count() == 0


def test_permutations_are_one_to_one(spark, make_docs):
    days = [r["d"] for r in spark.sql("SELECT date_format(date_add(DATE'1900-01-01', CAST(id * 7 AS INT)), 'yyyy-MM-dd') d FROM range(10000)").collect()]
    ips = [f"10.{i // 256}.{i % 256}.7" for i in range(3000)]
    texts = [r["text"] for r in P.mask(make_docs([(i, v, None, None, None) for i, v in enumerate(days + ips)]), "k").collect()]
    assert len(set(texts)) == len(days) + len(ips)


def test_what_fails_its_check_stays(make_docs, edge_rows):
    clean = ["4111111111111112", "999.1.1.1", "2024-02-30", "31/13/1999", "+1 23 45", "v1.2.3", "12345678901234567890123", "1899-12-31"]
    rows = P.mask(make_docs([(i, c, None, None, None) for i, c in enumerate(clean)]), "k").collect()
    assert [r["text"] for r in sorted(rows)] == clean
    docs = make_docs(edge_rows)
    assert sorted(((r["doc_id"], r["text"]) for r in P.mask(docs, "k").collect()), key=repr) == sorted(((r[0], r[1]) for r in edge_rows), key=repr)
    assert P.mask(make_docs([]), "k").count() == 0 and P.mask_documents(make_docs([]), "k").count() == 0


def test_email_and_no_python(make_docs):
    out = P.mask(make_docs([(1, "write a.b@mail.example.com or A.B@mail.example.com", None, None, None)]), "k")
    a, b = re.findall(r"[0-9a-f]{12}@mail\.example\.com", out.collect()[0]["text"])
    assert a == b
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_cards_beside_other_numbers(make_docs):
    key, c = "k1", "4111111111111111"
    spaced = lambda d: " ".join(d[i:i + 4] for i in range(0, 16, 4))
    new = card(c, key)
    old = [f"{spaced(c)} 12/27", f"{c} 123", f"order 12 {spaced(c)}", f"{c}-123", f"{spaced(c)} 12 2027 123", f"77 {c} 99 {spaced(c)} 5"]
    docs = make_docs([(i, t, None, None, None) for i, t in enumerate(old)])
    masked = P.mask_documents(docs, key)
    want = [t.replace(spaced(c), spaced(new)).replace(c, new) for t in old]
    assert [r["text"] for r in sorted(masked.collect())] == want
    assert [r["n_card"] for r in sorted(P.mask(docs, key).collect())] == [1] * len(old)
    assert [r["text"] for r in sorted(P.restore(masked, key).collect())] == old


def test_cards_in_any_run_are_restored(make_docs):
    rng = __import__("random").Random(3)
    group = lambda: str(rng.randrange(10 ** rng.randrange(1, 6)))
    cut = lambda d, k: " ".join(d[i:i + k] for i in range(0, len(d), k))
    old = [" ".join([group() for _ in range(rng.randrange(3))] + [cut(c, rng.choice([3, 4, 5, 19]))] + [group() for _ in range(rng.randrange(3))])
           for c in valid_cards(120) if len(c) >= 13]
    docs = make_docs([(i, t, None, None, None) for i, t in enumerate(old)])
    masked = P.mask_documents(docs, "k1")
    new = [r["text"] for r in sorted(masked.collect())]
    assert all(a != b and re.sub("[0-9]", "9", a) == re.sub("[0-9]", "9", b) for a, b in zip(old, new))
    assert [r["text"] for r in sorted(P.restore(masked, "k1").collect())] == old


def test_phones_in_all_forms_are_linked(make_docs):
    groups = [["+15551234567", "+1 555 123 4567", "+1-555-123-4567", "+1.555.123.4567", "(555) 123-4567", "555-123-4567", "555.123.4567"],
              ["+49 30 1234567", "+49301234567", "+49.30.1234567"], ["+353 1 234 5678", "+35312345678"],
              ["020 7946 0958", "(020) 7946 0958", "020-7946-0958"], ["01 23 45 67 89"]]
    old = [p for g in groups for p in g]
    docs = make_docs([(i, f"call {p}, or not", None, None, None) for i, p in enumerate(old)])
    masked = P.mask_documents(docs, "k")
    new = [re.fullmatch("call (.*), or not", r["text"])[1] for r in sorted(masked.collect())]
    assert [r["text"] for r in sorted(P.restore(masked, "k").collect())] == [r["text"] for r in sorted(docs.collect())]
    digits = iter(re.sub("[^0-9]", "", t) for t in new)
    for g, tail in zip(groups, (10, 9, 8, 10, 9)):
        tails = {next(digits)[-tail:] for _ in g}
        assert len(tails) == 1 and re.sub("[^0-9]", "", g[0])[-tail:] not in tails
    assert new[0].startswith("+1") and new[7].startswith("+49") and new[10].startswith("+353")


def test_a_phone_does_not_hide_a_card(make_docs):
    old = [f"{p} 4111 1111 1111 1111 12/27" for p in ("+49 30 123456", "+1 555 123 4567", "020 7946 0958")]
    rows = P.mask(make_docs([(i, t, None, None, None) for i, t in enumerate(old)]), "k").collect()
    assert all((r["n_phone"], r["n_card"]) == (1, 1) for r in rows)


def test_month_first_dates(make_docs):
    old = [f"{m:02d}/{d:02d}/{y}" for m in (1, 2, 7, 12) for d in (13, 28) for y in range(1990, 2010)]
    docs = make_docs([(i, t, None, None, None) for i, t in enumerate(old)])
    masked = P.mask_documents(docs, "k")
    new = [r["text"] for r in sorted(masked.collect())]
    assert len(set(new)) == len(old) and all(a != b and int(b[:2]) <= 12 < int(b[3:5]) for a, b in zip(old, new))
    assert [r["text"] for r in sorted(P.restore(masked, "k").collect())] == old
