import hashlib
import zlib

import pytest

from tunekiln.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=None):
    doc_id, _, lang, source, n_chars = row
    text = row[1] if text is None else text
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def climb(level):
    """All levels above a list of digests."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def steps(levels, i):
    """(left, right) siblings of the i-th node, level by level."""
    for level in levels[:-1]:
        a = i // 8 * 8
        yield "".join(level[a:i]), "".join(level[i + 1:a + 8])
        i //= 8


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in groups[g]])
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = [*steps(trees[g], i), *steps(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
            d = leaf(r, low) if hit else leaf(r)
            for a, b in path:
                d = H(a, d, b)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], H(*[x for p in path for x in p]), d, d == top[-1][0]))
    return out


def rows_of(sizes):
    return [(i, f"Text {i} of {lang}" if i % 5 else "small", lang, "src", i) for k, (lang, n) in enumerate(sizes) for i in range(k * 10_000, k * 10_000 + n)]


@pytest.mark.parametrize("sizes", [
    [("en", 1)], [("en", 9)], [("de", 1), ("en", 1)], [("a", 600), ("b", 1), (None, 65), ("é", 8), ("z", 9)],
    [(f"l{i:02d}", 1 + i % 3) for i in range(70)]])
def test_against_plain_hashing(make_docs, sizes):
    rows = rows_of(sizes)
    got = merkle.verify(make_docs(rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    assert any(r["verified"] for r in got)


def test_edges(make_docs, edge_rows):
    rows = edge_rows + [(None, None, None, None, None)] * 3
    got = merkle.verify(make_docs(rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))
    assert merkle.verify(make_docs([])).count() == 0


def test_shuffled_jumps(make_docs, monkeypatch):
    """The path for pointers that are too many to broadcast."""
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    rows = rows_of([("a", 700), ("b", 3)])
    assert sorted(map(tuple, merkle.verify(make_docs(rows)).collect())) == sorted(brute(rows))


def test_any_change_is_found(make_docs):
    rows = rows_of([("a", 40)])
    p = merkle.prove(make_docs(rows)).collect()
    for r in p:
        d = r["leaf"]
        for s in r["path"]:
            d = H(s["l"], d, s["r"])
        assert d == r["root"]
        other = H("x")
        for s in r["path"]:
            other = H(s["l"], other, s["r"])
        assert other != r["root"]
