import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from conftest import SF001
from tokenizers import Tokenizer

import __spark_entry__ as E
from tunekiln.llm import alignment


def spans(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(rows):
    """(doc_id, ...) by the libraries on each whole text, and all pairs of tokens compared."""
    left = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable}
    back |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    docs, counts = [], Counter()
    for d, text in rows:
        a = b = []
        if text:
            a = [(i, bytes(back[c] for c in left.id_to_token(i))) for i in left.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(right.id_to_piece(i)[1:-1], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()) for i in right.encode(text)]
            want = (" " + text).encode()
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a = b = []
        a, b = spans(a), spans(b)
        links, j = [], 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        parts, s = [], 0
        ia = ib = 0
        for e in ends:
            ga, gb = [], []
            while ia < len(a) and a[ia][2] <= e:
                ga.append(str(a[ia][0]))
                ia += 1
            while ib < len(b) and b[ib][2] <= e:
                gb.append(str(b[ib][0]))
                ib += 1
            parts.append(",".join(ga) + "|" + ",".join(gb))
        sha = hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""
        docs.append((d, len(a), len(b), len(ends), links, sha))
        counts.update(set(links))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return sorted(((d, na, nb, ng, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), sha)
                   for d, na, nb, ng, links, sha in docs), key=repr)


def same(spark, got, rows):
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    same(spark, E.queries()["op12_token_alignment"](spark, SF001), rows)


def test_edges(spark, make_docs, edge_rows, monkeypatch):
    odd = ["▁x y", "a▁", "é́ ﬁ ①", "<|endoftext|> <s>", "tab\tand\nline\n\nfeeds", "\U0001f600 \u0000 x", "  two  blanks  ", "don't ​ stop", "\r\n", "½ ² Ω İ"]
    rows = edge_rows + [(50 + i, t, None, None, None) for i, t in enumerate(odd)]
    pairs = [(r[0], r[1]) for r in rows]
    same(spark, alignment.alignment(make_docs(rows)), pairs)
    monkeypatch.setattr(alignment, "SMALL_ROWS", 0)
    same(spark, alignment.alignment(make_docs(rows).repartition(3)), pairs)
    assert alignment.alignment(make_docs([])).count() == 0
    assert alignment.alignment(make_docs([(1, None, None, None, None)])).collect()[0][1:] == (0,) * 6 + ("",)


def test_lots_of_any_size_agree():
    a, b = alignment.sides()
    texts = ["The quick brown fox, überall.", None, "ação e reação: naïveté", "", "quick quick quick", "x" * 500]
    whole = alignment.align(texts, a, b)
    for k, t in enumerate(texts):
        one = alignment.align([t], a, b)
        assert all(one[c][0] == whole[c][k] for c in ("n_a", "n_b", "n_groups", "n_links", "held", "groups_sha256"))
    assert whole["held"].sum() == len(whole["place"]) == len(whole["times"]) and whole["times"].sum() == whole["n_links"].sum()
