"""Scalar text rules as Spark column expressions (no UDFs).

Three rule families exist and are kept apart by name:
  A = analyzer (audit report), V = validator (score), T = training-time check.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's rules for equal results.
# ---------------------------------------------------------------------------
# Characters counted as CJK by A and V: CJK Unified 4E00-9FFF, Extension A 3400-4DBF,
# Hiragana + Katakana 3040-30FF, Hangul syllables AC00-D7AF, Extension B 20000-2A6DF.
CJK_CLASS = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{20000}-\x{2A6DF}]"
# T counts only CJK Unified and Extension A.
CJK_CLASS_T = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"
# A's bilingual check: a Han character (4E00-9FFF) and an ASCII letter.
HAN_CLASS = r"[\x{4E00}-\x{9FFF}]"
ASCII_LETTER_CLASS = r"[A-Za-z]"
# A's control characters, looked for in `instruction` only: tab, carriage return, NUL.
CONTROL_CLASS = r"[\t\r\x00]"
# Token estimate: 2.0 per CJK character, 0.3 per other character.
TOKENS_PER_CJK = 2.0
TOKENS_PER_OTHER = 0.3
# A: an output shorter than 5 characters after strip is "short".
SHORT_OUTPUT_CHARS = 5
# V: near-duplicate fingerprint = lower case, all white space removed, first 200 characters.
FINGERPRINT_CHARS = 200
# Python's str.strip()/str.split() white space: \t \n \v \f \r, 1C-1F, space, 85, A0, 1680,
# 2000-200A, 2028, 2029, 202F, 205F, 3000.
WS_CLASS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# ---------------------------------------------------------------------------

# The same white space as a literal character set (for trim / translate, which need no regex).
WS_CHARS = "".join(chr(c) for c in [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
FROM_KANA_CLASS = r"[^\x{0}-\x{303F}]"  # every class above starts at U+3040 or later
PREFIX_CHARS = 1000  # characters in which a fingerprint is looked for first
SIGMA = "\u03a3"     # the one capital whose lower case depends on what follows it
_NON_WS_CLASS = "[^" + WS_CLASS[1:-1] + "]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def char_len(t) -> Column:
    """Number of code points (Python ``len``); null counts as 0."""
    return F.coalesce(F.length(_c(t)), F.lit(0))


def _count_class(t: Column, cls: str) -> Column:
    """Characters of a class of U+3040 and above: texts of ASCII alone, or without such a character, need no count."""
    none = (F.octet_length(t) == F.char_length(t)) | ~t.rlike(FROM_KANA_CLASS)
    return F.when(none, F.lit(0)).otherwise(F.coalesce(F.regexp_count(t, F.lit(cls)), F.lit(0)))


def cjk_count(t) -> Column:
    """CJK characters under the A/V class."""
    return _count_class(_c(t), CJK_CLASS)


def cjk_count_t(t) -> Column:
    """CJK characters under T's narrower class."""
    return _count_class(_c(t), CJK_CLASS_T)


def _tokens(t, cjk: Column) -> Column:
    return cjk * F.lit(TOKENS_PER_CJK) + (char_len(t) - cjk) * F.lit(TOKENS_PER_OTHER)


def tokens_a(t) -> Column:
    """A's float token estimate; '' gives 0.0."""
    return _tokens(t, cjk_count(t)).cast("double")


def tokens_v(t) -> Column:
    """V's estimate truncated to an integer (Python ``int``)."""
    return _tokens(t, cjk_count(t)).cast("bigint")


def tokens_t(t) -> Column:
    """T's estimate: narrower CJK class, truncated."""
    return _tokens(t, cjk_count_t(t)).cast("bigint")


def py_strip(t) -> Column:
    """Python ``str.strip()``: Unicode white space at both ends. Plain ``trim`` strips only
    U+0020, so the full set is passed as trim characters (no regex, linear in the ends)."""
    return F.trim(_c(t), F.lit(WS_CHARS))


def is_blank(t) -> Column:
    """Empty after strip ⇔ no non-white-space character (the search stops at the first one)."""
    return F.coalesce(~_c(t).rlike(_NON_WS_CLASS), F.lit(True))


def fingerprint(t) -> Column:
    """V's near-duplicate key: lower case, all white space removed, first 200 characters.

    It counts near duplicates; rows are removed by ``text_key`` only. Lower-casing comes first, as
    it can depend on the neighbours of a letter (a Greek final sigma). The first PREFIX_CHARS characters
    decide where they hold enough and no such letter; else the whole text is normalised."""
    t = F.coalesce(_c(t), F.lit(""))
    head = t.substr(1, PREFIX_CHARS)
    start = _normalised(head)
    enough = (F.length(start) >= FINGERPRINT_CHARS) & ~F.contains(head, F.lit(SIGMA))
    return F.substring(F.when(enough, start).otherwise(_normalised(t)), 1, FINGERPRINT_CHARS)


def _normalised(t) -> Column:
    return F.translate(F.lower(F.coalesce(_c(t), F.lit(""))), WS_CHARS, "")


def text_key(t) -> Column:
    """Digest of the whole normalised text (lower case, no white space): the key of removal."""
    return F.unhex(F.md5(_normalised(t)))


def is_short_output(t) -> Column:
    return char_len(py_strip(F.coalesce(_c(t), F.lit("")))) < F.lit(SHORT_OUTPUT_CHARS)


def has_control(t) -> Column:
    return F.coalesce(_c(t).rlike(CONTROL_CLASS), F.lit(False))


def is_bilingual(t) -> Column:
    return F.coalesce(_c(t).rlike(HAN_CLASS) & _c(t).rlike(ASCII_LETTER_CLASS), F.lit(False))


def is_over_length(tokens, max_len) -> Column:
    return _c(tokens) > (max_len if isinstance(max_len, Column) else F.lit(max_len))


def seq_len_from_p95(p95) -> Column:
    """Max sequence length: next multiple of 512 above P95 tokens, at least 512, at most 16384."""
    p = _c(p95).cast("bigint")
    raw = F.greatest(F.lit(512), (F.floor(p / F.lit(512)) + F.lit(1)) * F.lit(512))
    return F.when(raw > F.lit(8192), F.least(raw, F.lit(16384))).otherwise(raw).cast("bigint")


def round_even(x, scale: int) -> Column:
    """Half-to-even rounding as numpy does it: rint(x · 10^d) / 10^d on doubles.

    This is also DuckDB's ``round_even``. Python's built-in ``round`` decides ties on the exact
    binary value instead, so for a double whose decimal form ends in a 5 at digit d+1 (e.g.
    0.12355 at 4 digits) the two can differ in the last digit."""
    f = float(10 ** scale)
    return F.rint(_c(x).cast("double") * F.lit(f)) / F.lit(f)
