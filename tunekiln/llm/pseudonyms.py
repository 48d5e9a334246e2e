"""Format-preserving pseudonyms of personal data by keyed Feistel permutations. DataFrame functions only.

Card numbers (Luhn-valid), international and national phone numbers, IPv4 addresses and dates found in whole texts are
permuted within their own format: eight Feistel rounds with an HMAC-like SHA-256 round function under a key, over the
number's digits (the last digit of a card is computed anew, a phone keeps its country code or leading 0, an address its
four bytes) or over the days from 1900-01-01 on. Equal values get equal pseudonyms in all documents and different values
of one format get different ones; ``restore`` undoes it with the key. Separators and lengths stay. The local part of an
e-mail address, which has no number format, becomes a keyed digest; it is not restored.

In a run of digit groups every stretch of groups with 13 to 19 digits is tested, so that a number beside a card does not
hide it. The stretch that ends first is taken, but none that cuts a valid stretch in a usual card layout. A pseudonym
that would let another stretch or a phone pass first is permuted again, as is a month-first date until its day exceeds 12 (else it
would read as day-first); such a value is restored, but its pseudonym differs from that of the same value elsewhere.
Where a later card in the run makes an overlapping usual layout pass by chance, ``restore`` cuts that run differently.

Rows are rewritten one by one, without a shuffle or Python. Runs that fail their check (Luhn, byte range, calendar,
digit count) are left as they are. The key is a parameter; it never enters the result.

Defined cases: a null text stays null with no findings, texts without findings stay as they are; repeated rows are
rewritten alike; an empty table gives an empty result; other columns are ignored, or passed through by ``mask_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "date", "address", "phone", "card")
CARD_AHEAD = r"(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])"
# national phones: 3-3-4 digits, or a leading 0 where it is no card and has no layout of a date
NATIONAL = (r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
            rf"|(?!{CARD_AHEAD}|[0-9]{{2}}[ .-][0-9]{{2}}[ .-][0-9]{{4}})(?:\(0[0-9]{{1,4}}\) ?|0[0-9]{{1,4}}[ .-])"
            r"(?:[0-9]{5,8}|[0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{2}(?:[ .-][0-9]{2}){3})")
# one alternation, so that no match is rewritten twice; runs start at their border, which keeps long texts linear
PATTERN = "|".join([
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])",
    r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    # up to 15 digits, but nothing of a card behind them
    rf"\+[0-9](?:(?![ -](?:{CARD_AHEAD}))[ .-]?\(?[0-9]\)?){{7,14}}(?![0-9])",
    rf"(?<![0-9A-Za-z_])(?:{NATIONAL})(?![0-9])",
    r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+",
])
# country codes of one and two digits; all others have three
CODE = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
# digits of the groups of a card as it is usually written
LAYOUTS = ("4 4 4 4", "4 6 5", "4 6 4", "4 4 4 4 3", *[str(n) for n in range(13, 20)])
WALK = 64  # permutations in a row; each has to be repeated in less than half of the cases
ROUNDS = 8
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1900-01-01", 271, 270  # 73,170 days, to 2100-05-01
DEMO_KEY = "tunekiln-demo-key"  # of the registered query; real jobs pass their own


def _int(c: Column) -> Column:
    return c.try_cast("bigint")


def _rounds(left: Column, right: Column, mod_left: Column, mod_right: Column, tweak: Column, key: str, back: bool) -> Column:
    """Alternating Feistel network over [0, mod_left) x [0, mod_right), as a struct (l, r)."""
    steps = list(range(1, ROUNDS + 1))
    sign = -1 if back else 1

    def noise(i, x):
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string"), F.lit(key)), 256)
        return _int(F.conv(F.substring(digest, 1, 15), 16, 10))

    def step(acc, i):
        even = i % 2 == 0
        l, r = acc["l"], acc["r"]
        return F.struct(F.when(even, l).otherwise(F.pmod(l + sign * F.pmod(noise(i, r), mod_left), mod_left)).alias("l"),
                        F.when(even, F.pmod(r + sign * F.pmod(noise(i, l), mod_right), mod_right)).otherwise(r).alias("r"))

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in (steps[::-1] if back else steps)]), start, step)


def _permute(digits: Column, tweak: str, key: str, back: bool) -> Column:
    """A string of two to eighteen digits to another of the same length."""
    n = F.char_length(digits)
    u = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("bigint")
    out = _rounds(_int(digits.substr(F.lit(1), u)), _int(digits.substr(u + 1, n - u)), power(u), power(n - u),
                  F.concat(F.lit(tweak), n.cast("string")), key, back)
    # the pair is used twice, so it is held in an array of one
    return F.element_at(F.transform(F.array(out), lambda p: F.concat(
        F.lpad(p["l"].cast("string"), u, F.lit("0")), F.lpad(p["r"].cast("string"), n - u, F.lit("0")))), 1)


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10."""
    rev, n = F.reverse(digits), F.char_length(digits)

    def part(i):
        v = _int(rev.substr(i, F.lit(1)))
        return F.when(i % 2 == 0, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("bigint"), lambda a, i: a + part(i)) % 10


def _refill(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced in order."""
    marks = F.split(text, "[0-9]", -1)
    new = F.transform(F.sequence(F.lit(1), F.char_length(digits)), lambda i: digits.substr(i, F.lit(1)))
    return F.array_join(F.zip_with(marks, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def kind_of(m: Column) -> Column:
    phone = m.startswith("+") | m.rlike(f"^(?:{NATIONAL})$")
    return (F.when(m.contains("@"), F.lit("email")).when(m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$|/"), F.lit("date"))
            .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.lit("address")).when(phone, F.lit("phone")).otherwise(F.lit("card")))


def _one(x: Column, fn) -> Column:
    """fn of a value that is computed once."""
    return F.element_at(F.transform(F.array(x), fn), 1)


def _walk(first: Column, step, done) -> Column:
    """step(first), and step again until ``done``: a permutation of the values for which ``done`` holds."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, i: F.when((i > 1) & done(x), x).otherwise(step(x)))


def _part(groups: Column, start: Column, k: Column) -> Column:
    """``k`` groups from ``start`` (from 1) on."""
    return F.transform(F.sequence(start, start + k - 1), lambda i: F.element_at(groups, i.cast("int")))


def _valid(groups: Column) -> Column:
    d = F.array_join(groups, "")
    return F.when(F.char_length(d).between(13, 19), _one(d, lambda x: _luhn(x) == 0)).otherwise(False)


def _usual(groups: Column) -> Column:
    return F.array_join(F.transform(groups, lambda g: F.char_length(g).cast("string")), " ").isin(*LAYOUTS)


def _ending(groups: Column, upto: Column) -> Column:
    """Number of groups of the best valid stretch that ends at group ``upto``, the longest one, and 100 more for the
    usual layouts, which come first; 0 for none."""
    def stretch(k):
        return _one(_part(groups, upto - k + 1, k), lambda g: F.when(_valid(g), F.when(_usual(g), k + 100).otherwise(k)).otherwise(0))

    return F.array_max(F.transform(F.sequence(F.lit(1), F.least(upto, F.lit(19))), stretch))


def _permuted_card(groups: Column, key: str, back: bool) -> Column:
    def of(d):
        body = _permute(d.substr(F.lit(1), F.char_length(d) - 1), "card", key, back)
        full = _one(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))
        return F.split(_refill(F.array_join(groups, " "), full), " ")

    return _one(F.array_join(groups, ""), of)


def _usual_stretches(groups: Column) -> Column:
    """The valid stretches in usual layouts, which no other stretch may cut: (i, j) of their first and last groups."""
    def start(i):
        return F.transform(F.sequence(F.lit(1), F.least(F.size(groups) - i + 1, F.lit(5))), lambda k: _one(
            _part(groups, i, k), lambda g: F.struct(i.alias("i"), (i + k - 1).alias("j"), (_usual(g) & _valid(g)).alias("ok"))))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.size(groups)), start)), lambda t: t["ok"])


def _card(m: Column, groups: Column, cards: Column, key: str, back: bool) -> Column:
    """The run with its valid stretches permuted, null if it has none."""
    none = F.array().cast("array<string>")

    def state(out, left, found):
        return F.struct(out.alias("out"), left.alias("left"), found.alias("found"))

    def take(a, j, v):
        """The state with the stretch ``v`` at the end of the groups left, which end at group j of the run."""
        n, k = F.size(a["left"]), v % 100
        # groups that could be read as a phone with a leading 0
        phone = lambda g: F.array_join(g, " ").rlike(f"^(?!{CARD_AHEAD})0[0-9]{{1,4}} ")
        before, old = F.slice(a["left"], F.lit(1), n - k), F.slice(a["left"], n - k + 1, k)

        def first(g):
            return (phone(g) == phone(old)) & _one(F.concat(before, g), lambda all_: F.forall(F.sequence(n - k + 1, n), lambda e: _one(
                _ending(all_, e), lambda x: F.when(e == n, x == v).otherwise((x == 0) | (v > 100) & (x < 100)))))

        cut = (v < 100) & F.exists(cards, lambda t: (t["i"] <= j) & (t["j"] > j))
        new = _walk(old, lambda g: _permuted_card(g, key, back), first)
        return F.when((v == 0) | cut, a).otherwise(state(F.concat(a["out"], before, new), none, F.lit(True)))

    def step(acc, j):
        # a stretch has 19 groups at most
        full, group = F.size(acc["left"]) >= 19, F.array(F.element_at(groups, j))
        out = F.when(full, F.concat(acc["out"], F.slice(acc["left"], 1, 1))).otherwise(acc["out"])
        left = F.concat(F.when(full, F.slice(acc["left"], 2, 18)).otherwise(acc["left"]), group)
        return _one(state(out, left, acc["found"]), lambda a: _one(_ending(a["left"], F.size(a["left"])), lambda v: take(a, j, v)))

    folded = F.aggregate(F.sequence(F.lit(1), F.size(groups)), state(none, none, F.lit(False)), step)
    return _one(folded, lambda x: F.when(x["found"], F.array_join(F.zip_with(
        F.split(m, "[0-9]+", -1), F.concat(x["out"], x["left"], F.array(F.lit(""))), lambda p, q: F.concat(p, q)), "")))


def _phone(m: Column, key: str, back: bool) -> Column:
    def of(d):
        kept = F.when(m.startswith("+"), F.regexp_extract(d, CODE, 0)).when(m.rlike(r"^\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$"), F.lit(
            "")).otherwise(F.lit("0"))
        full = _one(F.char_length(kept), lambda k: F.concat(kept, _permute(d.substr(k + 1, F.char_length(d) - k), "phone", key, back)))
        return F.when(F.char_length(d).between(8, 15), _refill(m, full))

    return _one(F.regexp_replace(m, "[^0-9]", ""), of)


def _address(m: Column, key: str, back: bool) -> Column:
    def of(p):
        b = [_int(p[i]) for i in range(4)]
        half = F.lit(65536).cast("bigint")
        out = _rounds(b[0] * 256 + b[1], b[2] * 256 + b[3], half, half, F.lit("address"), key, back)
        text = _one(out, lambda o: F.concat_ws(".", F.floor(o["l"] / 256).cast("string"), (o["l"] % 256).cast("string"),
                                               F.floor(o["r"] / 256).cast("string"), (o["r"] % 256).cast("string")))
        return F.when(F.forall(p, lambda x: _int(x) <= 255), text)

    return _one(F.split(m, "\\."), of)


def _date(m: Column, key: str, back: bool) -> Column:
    iso = m.contains("-")
    read = lambda form: F.try_to_timestamp(m, F.lit(form))
    day = F.when(iso, read("yyyy-MM-dd")).otherwise(read("dd/MM/yyyy")).cast("date")
    month_first = F.when(~iso & day.isNull(), read("MM/dd/yyyy").cast("date"))
    first = F.lit(FIRST_DAY).cast("date")

    def permuted(n):
        a, b = F.lit(DAYS_LEFT).cast("bigint"), F.lit(DAYS_RIGHT).cast("bigint")
        out = _rounds(F.floor(n / DAYS_RIGHT), n % DAYS_RIGHT, a, b, F.lit("date"), key, back)
        return _one(out, lambda o: (o["l"] * DAYS_RIGHT + o["r"]).cast("int"))

    def of(n, new, *forms):
        text = _one(F.date_add(first, new), lambda d: F.when(iso, F.date_format(d, forms[0])).otherwise(F.date_format(d, forms[-1])))
        return F.when(n.between(0, DAYS_LEFT * DAYS_RIGHT - 1), text)

    late = lambda n: F.dayofmonth(F.date_add(first, n)) > 12
    return F.coalesce(_one(F.date_diff(day, first), lambda n: of(n, permuted(n), "yyyy-MM-dd", "dd/MM/yyyy")),
                      F.when(month_first.isNotNull(), _one(F.date_diff(month_first, first), lambda n: of(
                          n, _walk(n, permuted, late), "MM/dd/yyyy"))))


def pseudonym(p: Column, key: str, back: bool = False) -> Column:
    """Pseudonym of one match (kind, old, groups, cards), null where it fails its check."""
    kind, m = p["kind"], p["old"]
    mail = F.concat(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 12), F.lit("@"),
                    F.substring_index(m, "@", -1))
    return (F.when(kind == "email", F.lit(None).cast("string") if back else mail).when(kind == "date", _date(m, key, back))
            .when(kind == "address", _address(m, key, back)).when(kind == "phone", _phone(m, key, back))
            .otherwise(_card(m, p["groups"], p["cards"], key, back)))


def _rewrite(d: DataFrame, text: Column, key: str, back: bool) -> DataFrame:
    """``d`` with _found, an array of (kind, old, new) of the matches, and _text, the new text.

    Built up column by column, as deeper nesting exceeds the analyzer's iterations."""
    matches = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: F.struct(
        kind_of(m).alias("kind"), m.alias("old")))
    groups = lambda p: F.when(p["kind"] == "card", F.split(p["old"], "[ -]"))
    d = d.withColumn("_found", matches)
    d = d.withColumn("_found", F.transform("_found", lambda p: F.struct(
        p["kind"].alias("kind"), p["old"].alias("old"), groups(p).alias("groups"))))
    d = d.withColumn("_found", F.transform("_found", lambda p: F.struct(
        p["kind"].alias("kind"), p["old"].alias("old"), p["groups"].alias("groups"), _usual_stretches(p["groups"]).alias("cards"))))
    d = d.withColumn("_found", F.transform("_found", lambda p: F.struct(
        p["kind"].alias("kind"), p["old"].alias("old"), pseudonym(p, key, back).alias("new"))))
    parts = F.concat(F.transform("_found", lambda p: F.coalesce(p["new"], p["old"])), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.split(text, PATTERN, -1), parts, lambda a, b: F.concat(a, b)), "")
    return d.withColumn("_text", F.when(F.size("_found") > 0, joined).otherwise(text))


def mask_documents(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, with their texts rewritten (``back``: restored)."""
    text = F.col("_doc.text").cast("string")
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    d = _rewrite(d, text, key, back)
    return d.select(*[F.col("_text").alias("text") if c == "text" else F.col(f"_doc.{c}").alias(c) for c in docs.columns])


def restore(docs: DataFrame, key: str) -> DataFrame:
    return mask_documents(docs, key, back=True)


def mask(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_email, n_date, n_address, n_phone, n_card): rewritten texts and how many of each kind."""
    d = _rewrite(docs.select("doc_id", F.col("text").cast("string").alias("text")), F.col("text"), key, False)
    d = d.withColumn("_found", F.coalesce("_found", F.array().cast("array<struct<kind:string,old:string,new:string>>")))
    n = lambda k: F.size(F.filter("_found", lambda p: (p["kind"] == k) & p["new"].isNotNull())).cast("bigint").alias(f"n_{k}")
    return d.select("doc_id", F.col("_text").alias("text"), *[n(k) for k in KINDS])
