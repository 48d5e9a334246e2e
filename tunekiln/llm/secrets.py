"""Secret scans with a token-efficiency test.

Base kinds, leftmost and non-overlapping per kind: ``assign`` (a name such as password followed by a
value), ``access`` (access key ids) and ``hex`` (long hexadecimal runs). The method adds ``random``:
a run of key characters that a byte-pair vocabulary splits into many short tokens is unlikely to be
words. Before the test, known digests (hexadecimal runs of digest lengths) and identifiers (UUIDs,
numbers, and names, paths and snake_case without digits whose parts are one-case or capitalised words) are
excluded. A run that passes as a whole is judged by its parts between ``/``, ``=``, ``_`` and ``-`` as well. The
vocabulary is a tiktoken rank file whose path is a parameter.

The scan is row by row over whole texts, without a shuffle. Of a run that base spans cover in part, what lies
beside them is judged; a random span never overlaps a base span.

Defined cases: null and empty texts have no spans; repeated rows are judged alike; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[A-Za-z0-9+]{20,}")
JOINS = "/_=-"
WORDS = re.compile(r"(?:[+/_=-]*(?:[A-Z]?[a-z]+|[A-Z]+)(?![A-Za-z]))*[+/_=-]*\Z|(?:[A-Z][a-z]{2,})+\Z")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)  # md5, sha1, sha224, sha256, sha384, sha512
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z")
MAX_RATIO = 2.2   # characters a token, at most
SHORTEST = 20     # characters of a run, at least


@lru_cache(maxsize=4)
def encoder(path: str | None = None):
    """The tiktoken encoding of a rank file (None: the public byte-level file)."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_identifier(run: str) -> bool:
    """Digests, UUIDs, numbers, and names, paths and snake_case of letters alone."""
    if UUID.match(run) or len(run) in DIGEST_LENGTHS and DIGEST.match(run):
        return True
    if any(c.isdigit() for c in run):
        return not any(c.isalpha() for c in run)
    return WORDS.match(run) is not None


def efficiency(run: str, path: str | None = None) -> float:
    """Characters per token."""
    return len(run) / max(1, len(encoder(path).encode_ordinary(run)))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def random_spans(text: str, base: list[tuple[str, int, int]], max_ratio: float = MAX_RATIO, path: str | None = None):
    out, taken = [], sorted((a, b) for _, a, b in base)
    at = 0
    for m in RUN.finditer(text):
        start, end = m.span()
        # the stretches of the run that no base span covers
        free = []
        while at < len(taken) and taken[at][0] < end:
            if taken[at][1] > start:
                free.append((start, taken[at][0]))
                start = max(start, taken[at][1])
            if taken[at][1] > end:
                break
            at += 1
        free.append((start, end))
        for a, b in free:
            if (a, b) != m.span():  # without the marks that joined it to a base span
                a += len(text[a:b]) - len(text[a:b].lstrip(JOINS))
                b = a + len(text[a:b].rstrip(JOINS))
            if b - a >= SHORTEST:
                out += _judge(text, a, b, max_ratio, path)
    return out


def _judge(text: str, a: int, b: int, max_ratio: float, path: str | None):
    run = text[a:b]
    if not is_identifier(run) and efficiency(run, path) <= max_ratio:
        return [("random", a, b)]
    if UUID.match(run):
        return []
    return [("random", *p.span()) for p in PART.finditer(text, a, b)
            if p.span() != (a, b) and not is_identifier(p[0]) and efficiency(p[0], path) <= max_ratio]


def find(text: str | None, max_ratio: float = MAX_RATIO, path: str | None = None):
    """(base spans, all spans), each sorted by start, then kind as listed."""
    if not text:
        return [], []
    base = base_spans(text)
    more = random_spans(text, base, max_ratio, path)
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, max_ratio: float = MAX_RATIO, path: str | None = None) -> DataFrame:
    """(doc_id, base_spans, spans): arrays of (kind, start, end), code points, end exclusive."""
    def rows(texts):
        found = [find(t, max_ratio, path) for t in texts]
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        return {"base_spans": [as_rows(b) for b, _ in found], "spans": [as_rows(s) for _, s in found]}

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return per_text(docs, [F.col("doc_id")], rows, f"base_spans {span}, spans {span}")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scanned.select("doc_id", n("assign"), n("access"), n("hex"),
                          F.sha2(text("base_spans"), 256).alias("base_sha256"), text("spans").alias("spans"))
