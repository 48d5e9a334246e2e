"""Measures of one whole text, used by several operators (plain Python and numpy, no Spark)."""

from __future__ import annotations

from collections import Counter

import numpy as np

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def without(data: bytes, chars: bytes) -> int:
    """Length of ``data`` after removing all of ``chars``."""
    return len(data.translate(None, chars))


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Number of words inside windows of ``size`` words that occur twice or more (all occurrences count)."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.uint64, count=len(words))
    if len(ids) == len(words):
        return 0
    h = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        h ^= (codes[i:i + n] + np.uint64(i + 1)) * _MIX[i % len(_MIX)]
        h = (h << np.uint64(13) | h >> np.uint64(51)) * _MIX[0]
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if len(same) == 0:
        return 0
    a, b = order[same], order[same + 1]
    if all(np.array_equal(codes[a + i], codes[b + i]) for i in range(size)):
        starts = np.union1d(a, b)
    else:  # two different windows share a hash: count the windows themselves
        windows = list(zip(*[words[i:i + n] for i in range(size)]))
        counts = Counter(windows)
        starts = np.array([i for i, x in enumerate(windows) if counts[x] > 1], dtype=np.int64)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(lines: list[bytes]) -> list[bool]:
    """For each line, whether it has a word and equals an earlier line."""
    seen: set[bytes] = set()
    out = []
    for line in lines:
        if not line or line.isspace() or not line.strip(BLANKS):
            out.append(False)
            continue
        out.append(line in seen)
        seen.add(line)
    return out
