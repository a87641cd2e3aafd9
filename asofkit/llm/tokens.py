"""Byte-level BPE ids of whole texts, by the tokenizers library, each distinct word asked for once.

A single space between two characters that aren't white space always starts a new pre-token of the
byte-level pattern, and so does an ASCII mark after a letter and an ASCII letter after a single line feed, so texts may be cut
there and the ids of the words put together. Words of a
run of texts are found, hashed (two polynomials modulo 2**64 over their bytes, 128 bits and the length) and matched with a
bounded table of known words in numpy; only new words pass through the tokenizer. Where a character
beside a space might be white space the texts aren't cut, which only makes words longer.

Strings of added tokens, special ones too, become their ids as in the library's plain call: texts are cut there first. The texts of a
tokenizer with a normalizer, another pre-tokenizer, or added tokens that take in what stands around them aren't cut at all.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np

#: End-of-document id that follows the ids of every document.
END_ID = 0
#: Known words that a worker keeps, at most, and the bytes of the longest one it keeps.
TABLE_WORDS = 600_000
WORD_BYTES = 48
#: Bytes of a run.
RUN_BYTES = 1_000_000

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_space = np.zeros(256, bool)
_space[[*range(9, 14), *range(28, 33)]] = True
_letter, _mark = np.zeros(256, bool), np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True
_mark[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: First bytes of characters that might be white space: U+0085 and U+00A0, and U+1680 up to U+3000.
_lead3 = np.zeros(256, bool)
_lead3[[0xE1, 0xE2, 0xE3]] = True


class _Powers:
    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = int(base), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            ahead = np.uint64(pow(self.base, m, 1 << 64)), np.uint64(pow(self.base, -m, 1 << 64))
            self.up, self.down = np.concatenate([self.up, self.up * ahead[0]]), np.concatenate([self.down, self.down * ahead[1]])
        return self.up[:n], self.down[:n]


_powers = [_Powers(b) for b in _BASES]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two polynomial hashes modulo 2**64 of the spans of *data* from *start* up to *end*."""
    hashes = []
    for p in _powers:
        up, down = p.upto(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        hashes.append((sums[end] - sums[start]) * down[start])
    return hashes


def word_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where words start in UTF-8 *data*, whose texts start at *begins*: at places where a pre-token is sure to start."""
    n = len(data)
    at = np.flatnonzero(data == 32)
    at = at[(at > 2) & (at < n - 2)]  # at the rim a word is just longer
    before, after = data[at - 1], data[at + 1]
    odd = _space[before] | _space[after] | _lead3[data[at - 3]] | _lead3[after]
    odd |= (data[at - 2] == 0xC2) & ((before == 0xA0) | (before == 0x85)) | (after == 0xC2)
    at = at[~odd]
    first = np.zeros(n + 1, bool)
    first[at] = True
    mark = np.flatnonzero(_mark[data])
    mark = mark[mark > 1]
    last, lead = data[mark - 1], data[mark - 2]
    first[mark[_letter[last] | (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)]] = True
    line = np.flatnonzero(data == 10) + 1
    line = line[(line < n) & (line > 1)]
    alone = data[line - 2]
    first[line[_letter[data[line]] & (alone < 0x80) & ~_space[alone]]] = True
    first[begins] = True
    return np.flatnonzero(first[:n])


class _Table:
    """Known words by hash: sorted first hashes, second hashes, and where their ids are in the pool."""

    def __init__(self):
        self.h1 = self.h2 = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int32)
        self.runs = np.empty(0, np.int32)  # in how many runs a word was met
        self.pool, self.used = np.empty(0, np.uint32), 0

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Positions, or -1."""
        if not len(self.h1):
            return np.full(len(h1), -1)
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        return np.where((self.h1[at] == h1) & (self.h2[at] == h2), at, -1)

    def has(self, h1: np.ndarray) -> np.ndarray:
        return self.h1[np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)] == h1 if len(self.h1) else np.zeros(len(h1), bool)

    def add(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Adds words in ascending order of *h1*; their ids follow each other in *ids*."""
        at = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.append(ids)
        place = np.searchsorted(self.h1, h1)
        self.h1, self.h2 = np.insert(self.h1, place, h1), np.insert(self.h2, place, h2)
        self.at, self.size = np.insert(self.at, place, at), np.insert(self.size, place, sizes)
        self.runs = np.insert(self.runs, place, 0)

    def trim(self) -> None:
        """Forgets words that were met in one run only, and the less frequent half if too many are left."""
        keep = self.runs > 1
        if keep.sum() > TABLE_WORDS // 2:
            keep = self.runs > np.partition(self.runs, -TABLE_WORDS // 2)[-TABLE_WORDS // 2]
        at, size = self.at[keep], self.size[keep]
        stop = np.cumsum(size, dtype=np.int64)
        take = np.arange(stop[-1] if len(stop) else 0) + np.repeat(at - (stop - size), size)
        self.pool, self.used = self.pool[take], len(take)
        self.h1, self.h2, self.at, self.size, self.runs = self.h1[keep], self.h2[keep], stop - size, size, self.runs[keep]

    def append(self, ids: np.ndarray) -> int:
        """Puts *ids* at the end of the pool and says where."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(self.used, np.uint32)])
        self.pool[at : self.used] = ids
        return at


class TextEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._table = _Table()
        self._bytes = np.zeros(self._tokenizer.get_vocab_size(), np.int64)  # of each token: the alphabet has one character per byte
        for token, i in self._tokenizer.get_vocab().items():
            self._bytes[i] = len(token)
        parts = json.loads(self._tokenizer.to_str())
        before, added = parts["pre_tokenizer"] or {}, parts["added_tokens"]
        around = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self._cuts = not parts["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and not around
        self._added = {t["content"]: t["id"].to_bytes(4, "little") for t in added}
        self._at_added = re.compile("|".join(re.escape(t) for t in sorted(self._added, key=len, reverse=True)) or r"(?!)")

    def _ask(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _ask_joined(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has, from one text of all of them.

        Each word starts with a space before other than white space and ends with other than white space, so that all words are pre-tokens
        of their own in that text too; their ids are told apart by the tokens' lengths in bytes.
        """
        length = end - start
        stop = np.cumsum(length)
        joined = data[np.repeat(start - (stop - length), length) + np.arange(stop[-1])].tobytes().decode()
        ids = np.array(self._tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        reached = np.cumsum(self._bytes[ids])
        last = np.searchsorted(reached, stop)
        if reached[-1] != stop[-1] or (reached[last] != stop).any():
            raise AssertionError("words aren't pre-tokens of their own")
        return ids, np.diff(last + 1, prepend=0).astype(np.int32)

    def _run(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece; none is empty."""
        raw = b"".join(pieces)
        data = np.frombuffer(raw, np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(p) for p in pieces[:-1]], dtype=np.int64)]).astype(np.int64)
        start = word_starts(data, begins)
        end = np.append(start[1:], len(data))
        hashes = span_hashes(data, start, end)
        h1, h2 = hashes[0] * np.uint64(31) + (end - start).astype(np.uint64), hashes[1]
        keys, first, inverse = np.unique(h1, return_index=True, return_inverse=True)
        second = h2[first]
        alone = np.flatnonzero(h2 != second[inverse])  # equal first hashes of unequal words
        if len(self._table.h1) + len(keys) > TABLE_WORDS:
            self._table.trim()
        table = self._table
        new = np.flatnonzero(table.find(keys, second) < 0)
        long = (end - start)[first[new]] > WORD_BYTES
        text = lambda i: raw[start[i] : end[i]].decode()
        kept, once = new[~long], new[long]
        if len(kept):
            fresh = ~table.has(keys[kept])
            kept, clash = kept[fresh], kept[~fresh]
            once = np.concatenate([once, clash])
            s, e = start[first[kept]], end[first[kept]]
            tail, before = data[e - 1], data[np.maximum(e - 2, 0)]
            closed = (tail < 0x80) & ~_space[tail] | (tail >= 0x80) & (before == 0xC3)
            plain = (data[s] == 32) & (e - s > 1) & closed & ~np.isin(s, begins)
            if plain.any():
                table.add(keys[kept[plain]], second[kept[plain]], *self._ask_joined(data, s[plain], e[plain]))
            if len(rest := kept[~plain]):
                ids = self._ask([text(first[i]) for i in rest])
                table.add(keys[rest], second[rest], np.concatenate(ids), np.array([len(x) for x in ids], np.int32))
        place = table.find(keys, second)
        table.runs[place[place >= 0]] += 1
        pool_at, sizes = (table.at[place], table.size[place]) if len(table.h1) else (np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32))
        end_of_words = table.used
        for i, ids in zip(once, self._ask([text(first[i]) for i in once]) if len(once) else []):
            pool_at[i], sizes[i] = table.append(ids), len(ids)
        where, count = pool_at[inverse], sizes[inverse]
        for i in alone:
            ids = self._ask([text(i)])[0]
            where[i], count[i] = table.append(ids), len(ids)
        stop = np.cumsum(count, dtype=np.int64)
        take = np.arange(stop[-1]) + np.repeat(where - (stop - count), count)
        out = table.pool[take].astype("<u4")
        table.used = end_of_words  # what isn't kept
        edges = np.append(np.searchsorted(start, begins), len(start))
        totals = np.concatenate([[0], stop])[edges]
        return [out[a:b].tobytes() for a, b in zip(totals[:-1], totals[1:])]

    def raw(self, texts: Iterable[str | None]) -> list[bytes]:
        """For each whole text its little-endian unsigned 32-bit ids; a null text has none."""
        parts: list[list[bytes]] = []
        run: list[bytes] = []
        owner: list[tuple[int, int]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if run:
                for (i, place), ids in zip(owner, self._run(run)):
                    parts[i][place] = ids
            run.clear()
            owner.clear()
            size = 0

        def later(data: bytes) -> None:
            nonlocal size
            run.append(data)
            owner.append((len(parts) - 1, len(parts[-1])))
            parts[-1].append(b"")
            size += len(data)
            if size > RUN_BYTES:
                flush()

        for text in texts:
            parts.append([])
            if not self._cuts:
                parts[-1].append(self._ask([text or ""])[0].astype("<u4").tobytes())
                continue
            for piece in self._pieces(text or ""):
                if (known := self._added.get(piece)) is not None:
                    parts[-1].append(known)
                    continue
                data = piece.encode()
                while len(data) > RUN_BYTES:  # a very long text goes by pieces, cut where a word starts
                    starts = word_starts(np.frombuffer(data, np.uint8, RUN_BYTES), np.zeros(1, np.int64))
                    if (cut := int(starts[-1])) == 0:
                        break
                    later(data[:cut])
                    flush()
                    data = data[cut:]
                if len(data) > RUN_BYTES:
                    parts[-1].append(self._ask([data.decode()])[0].astype("<u4").tobytes())
                elif data:
                    later(data)
        flush()
        return [p[0] if len(p) == 1 else b"".join(p) for p in parts]

    def _pieces(self, text: str) -> Iterator[str]:
        """*text* cut around the strings of added tokens."""
        at = 0
        for m in self._at_added.finditer(text) if any(t in text for t in self._added) else ():
            yield text[at : m.start()]
            yield m[0]
            at = m.end()
        yield text[at:]

    def documents(self, texts: Sequence[str | None], at_once: int = 1_000) -> Iterator[bytes]:
        """The ids of each text, and the end id."""
        end = END_ID.to_bytes(4, "little")
        for i in range(0, len(texts), at_once):
            for ids in self.raw(texts[i : i + at_once]):
                yield ids + end


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)
