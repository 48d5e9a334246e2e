"""Whole texts to token ids with a public vocabulary, with a memo for repeated words.

A byte-level BPE file that splits by the usual pattern, and a piece vocabulary that splits by white space, encode
each word (with the blank before it) on its own. Where every white space character of a text stands alone between
two others, the words between blanks and line feeds can therefore be encoded one by one and remembered; other
texts, and those with a special token's string, go to the library whole. A batch's words become a dictionary and
places in it (Arrow), only new words of the dictionary reach the library, and the ids are gathered by place.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO = 350_000  # remembered words (some 15 MB); beyond that the less used half is forgotten
REST = 150_000  # words that stay remembered between tasks
LOT = 4096      # words given to the library at once
MARKS = ".,!?;:#*$%&|"
# white space of Unicode, as the libraries' patterns see it
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = f"^{_WS}|{_WS}{_WS}|{_WS}$"


def _gather(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches of ``ids`` at ``start`` of length ``n``, one after the other."""
    total = int(n.sum())
    kind = np.int32 if max(total, len(ids)) < 1 << 30 else np.int64
    at = np.repeat((start - (np.cumsum(n) - n)).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return ids[at]


def _flat(parts: list, dtype) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return np.concatenate([np.asarray(p, dtype=dtype) for p in parts]) if parts else np.zeros(0, dtype=dtype), n


class Words:
    """Ids of whole texts by their words; subclasses give ``learn`` (new words to flat ids and counts), ``whole``
    and whether texts can be taken ``by_word``. The memo is a column of words with their stretches of ids."""

    def __init__(self, width: int, feed: list[int], marks: list[str], by_word: bool):
        self.width, self.dtype = width, np.dtype("<u2" if width == 2 else "<u4")
        self.feed, self.marks, self.by_word = feed, marks, by_word and len(feed) == 1
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.start, self.count, self.hits = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.ids = np.zeros(0, dtype=self.dtype)

    def rest(self) -> None:
        """Give memory back at the end of a task; the worker may go on with other work."""
        if len(self.words) > REST:
            self._shrink(REST)
        pa.default_memory_pool().release_unused()

    def _shrink(self, most: int) -> None:
        keep = np.sort(np.argsort(-self.hits, kind="stable")[:most])
        self.ids = _gather(self.ids, self.start[keep], self.count[keep])
        self.words, self.count, self.hits = self.words.take(pa.array(keep)), self.count[keep], self.hits[keep] // 2
        self.start = np.cumsum(self.count) - self.count

    def _known(self, names: pa.Array) -> np.ndarray:
        """Places of words in the memo; new ones are learnt."""
        if len(self.words) > MEMO:
            self._shrink(MEMO // 2)
        at = pc.index_in(names, value_set=self.words)
        new = at.is_null()
        at = at.fill_null(0).to_numpy().astype(np.int64)
        fresh = names.filter(new)
        if len(fresh):
            ids, n = self.learn(fresh)
            at[new.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(fresh))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
            self.count, self.hits = np.concatenate([self.count, n]), np.concatenate([self.hits, np.zeros(len(n), dtype=np.int64)])
            self.ids = np.concatenate([self.ids, ids])
            self.words = pa.concat_arrays([self.words, fresh])
        self.hits[at] += 1
        return at

    def _by_word(self, texts: pa.Array, bare: bool) -> tuple[np.ndarray, np.ndarray]:
        lines = pc.replace_substring(texts, "\n", " \n")
        if bare:  # a line feed put in front stands for the start of the text; its id is cut off again
            lines = pc.binary_join_element_wise(pa.scalar("\n", lines.type), lines, pa.scalar("", lines.type))
        lists = pc.split_pattern(lines, " ")
        words = lists.flatten().dictionary_encode()
        slots = self._known(words.dictionary)[words.indices.to_numpy()]
        n = self.count[slots]
        ids = _gather(self.ids, self.start[slots], n)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(pc.list_value_length(lists).to_numpy())]
        counts = np.diff(ends, prepend=0)
        if bare:
            keep = np.ones(len(ids), dtype=bool)
            keep[ends - counts] = False
            return ids[keep], counts - 1
        return ids, counts

    def flat(self, texts: pa.Array, bare: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids in the order of ``texts`` and the number of ids of each; null counts as empty.

        With ``bare`` false, a blank stands before each text that is not empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
        texts = texts.cast(pa.large_string()).fill_null("")
        full = pc.not_equal(texts, "")
        odd = pc.match_substring_regex(texts, _ODD) if self.by_word else full
        for m in self.marks:
            odd = pc.or_(odd, pc.match_substring(texts, m))
        odd = pc.and_(odd, full).to_numpy(zero_copy_only=False)
        plain = full.to_numpy(zero_copy_only=False) & ~odd
        counts = np.zeros(len(texts), dtype=np.int64)
        ids, whole = np.zeros(0, dtype=self.dtype), np.zeros(0, dtype=self.dtype)
        if plain.any():
            ids, counts[plain] = self._by_word(texts.filter(pa.array(plain)), bare)
        if odd.any():
            whole, counts[odd] = self.whole(texts.filter(pa.array(odd)).to_pylist(), bare)
        if not odd.any():
            return ids, counts
        out, by = np.empty(counts.sum(), dtype=self.dtype), np.repeat(odd, counts)
        out[by], out[~by] = whole, ids
        return out, counts

    def encode(self, texts) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers."""
        ids, counts = self.flat(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string()))
        data, ends = ids.tobytes(), np.cumsum(counts) * self.width
        return [data[e - n * self.width:e] for e, n in zip(ends.tolist(), counts.tolist())]


class Encoder(Words):
    """A file of the ``tokenizers`` library."""

    def __init__(self, path: str | None = None, plain_marks: bool = False):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("byte_bpe_50k.json")
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = plain_marks  # their strings in a text are then ordinary text
        settings = str(self.lib.pre_tokenizer)
        feed = self.lib.encode("\n", add_special_tokens=False).ids
        super().__init__(2 if self.lib.get_vocab_size() <= 1 << 16 else 4, feed, [t.content for t in self.lib.get_added_tokens_decoder().values()],
                         settings.startswith("ByteLevel") and "add_prefix_space=False" in settings and "use_regex=True" in settings and self.lib.normalizer is None)

    def whole(self, texts: list[str], bare: bool = True) -> tuple[np.ndarray, np.ndarray]:
        lead = "" if bare else " "
        return _flat([e.ids for e in self.lib.encode_batch_fast([lead + t for t in texts], add_special_tokens=False)], self.dtype)

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A word follows a blank, or a line feed that it then starts with. Marks at its end, after a letter or
        digit, are encoded apart, as the library splits there; the rest of the words go to the library as the
        lines of one text, and the ids are cut at the line feeds again."""
        core, tails = pc.utf8_rtrim(words, characters=MARKS), np.full(len(words), "", dtype=object)
        # only words that end in a mark are looked at further
        ends = pc.not_equal(pc.binary_length(core), pc.binary_length(words))
        if pc.any(ends).as_py():
            full, cut = words.filter(ends), core.filter(ends)
            split = pc.match_substring_regex(cut, r"[\pL\pN]$")
            core = pc.replace_with_mask(words, ends, pc.if_else(split, cut, full))
            tail = pc.replace_substring_regex(full, f"(?s)^.*?([{re.escape(MARKS)}]*)$", r"\1")
            tails[ends.to_numpy(zero_copy_only=False)] = pc.if_else(split, tail, pa.scalar("", words.type)).to_numpy(zero_copy_only=False)
        tails = pa.array(tails, words.type).dictionary_encode()
        cores = core.dictionary_encode()
        ids, n = self._lines(cores.dictionary.to_pylist())
        marks, m = self.whole(tails.dictionary.to_pylist())
        at, tail = cores.indices.to_numpy(), tails.indices.to_numpy()
        begin, behind = np.cumsum(n) - n, len(ids) + np.cumsum(m) - m
        start = np.stack([begin[at], behind[tail]], axis=1).ravel()
        length = np.stack([n[at], m[tail]], axis=1)
        return _gather(np.concatenate([ids, marks]), start, length.ravel()), length.sum(axis=1)

    def _lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = [], []
        for k in range(0, len(words), LOT):
            lot = words[k:k + LOT]
            after_feed = np.array([w.startswith("\n") for w in lot])
            text = "\n".join(w[1:] if b else " " + w for w, b in zip(lot, after_feed.tolist())) + "\n"
            ids, _ = self.whole([text])
            ends = np.flatnonzero(ids == self.feed[0])
            if len(ends) == len(lot):
                # a line's feed stands behind it; in front of the words that start with one it is kept
                begin = np.concatenate([[0], ends[:-1] + 1])
                ids = np.concatenate([np.array(self.feed, dtype=self.dtype), ids])
                start = np.stack([np.zeros(len(lot), dtype=np.int64), begin + 1], axis=1).ravel()
                length = np.stack([after_feed.astype(np.int64), ends - begin], axis=1)
                parts.append(_gather(ids, start, length.ravel()))
                counts.append(length.sum(axis=1))
            else:  # a line that held other line feeds
                ids, n = self.whole([w if b else " " + w for w, b in zip(lot, after_feed.tolist())])
                parts.append(ids)
                counts.append(n)
        return np.concatenate(parts), np.concatenate(counts)


class Pieces(Words):
    """A ``sentencepiece`` model. It adds the blank before a text itself."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("piece_bpe_32k.model")
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.lib.get_piece_size()
        pieces = [self.lib.id_to_piece(i) for i in range(size)]
        # no piece reaches over the start of a word, but those of blanks alone
        apart = not any("▁" in p[1:] and p.strip("▁") or "\n" in p for p in pieces)
        blank, feed = self.lib.piece_to_id("▁"), self.lib.encode("\n")
        super().__init__(2 if size <= 1 << 16 else 4, feed[1:], [], apart and feed[:1] == [blank])

    def whole(self, texts: list[str], bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
        if bare:
            raise ValueError("a piece model encodes texts with a blank before them")
        return _flat(self.lib.encode(texts, num_threads=1), self.dtype)

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = words.to_pylist()
        ids, n = self.whole(words)
        # a word that starts with a line feed has no blank before it
        skip = np.array([w.startswith("\n") for w in words]).astype(np.int64)
        return _gather(ids, np.cumsum(n) - n + skip, n - skip), n - skip


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    return Encoder(path)
