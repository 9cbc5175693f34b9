"""Token ids of whole texts by a lower-casing word-end BPE tokenizer file, over arrays.

The tokenizers library defines the ids; it needs about 7 microseconds a word, so this module merges all distinct
words of a batch at once with numpy and takes the library itself for whatever is not plain:

- texts with a code point outside tab to carriage return, 0x20-0x7E and 0xA1-0x24F (or with 0x130, whose lower case
  has two), or with "<|", which can begin a special token;
- runs of over LONG bytes.

On plain texts the file's steps are: lower case; cut into contractions, runs of letters, single numbers and runs of
other characters, white space dropped; map bytes to symbols, the last with a word-end mark; merge pairs by rank.
Merging the pair of least rank of every word, leftmost first, until none is left gives the library's ids; tests
compare them.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache
from pathlib import Path

import numpy as np

from clearstack.llm import words

LONG = 48
_NONE = 1 << 30
#: Words' ids that a worker keeps between batches, in a direct-mapped table: 2^21 entries and at most so many ids, about 100 MB.
CACHE_BITS, CACHE_IDS = 21, 16_000_000
_ODD = re.compile("[^\t-\r -~¡-įı-ɏ]|<\\|")
_CONTROL = np.zeros(256, bool)
_CONTROL[[*range(9), *range(14, 32), 127]] = True
_SLOTS = 20


def _byte_symbols() -> list[str]:
    """The printable character for each byte in byte-level BPE: printable Latin-1 bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    symbol = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [symbol[b] for b in range(256)]


class PairTable:
    """From a pair of ids to its rank and merged id: two hash tables, the second for what collides in the first."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray) -> None:
        self.merged = merged.astype(np.int32)
        ranks = np.arange(len(pairs), dtype=np.int32)
        self.tables = []
        left = np.arange(len(pairs))
        for multiplier in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F):
            slot = (pairs[left] * np.uint32(multiplier)) >> np.uint32(32 - _SLOTS)
            key, rank = np.full(1 << _SLOTS, 0xFFFFFFFF, np.uint32), np.full(1 << _SLOTS, _NONE, np.int32)
            _, first = np.unique(slot, return_index=True)
            key[slot[first]], rank[slot[first]] = pairs[left[first]], ranks[left[first]]
            self.tables.append((np.uint32(multiplier), key, rank))
            left = np.delete(left, first)
            if not len(left):
                return
        raise ValueError("pairs collide in every table")

    def rank(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where there is no merge or a side is negative."""
        pair = (one.astype(np.uint32) << np.uint32(16)) | (other.astype(np.uint32) & np.uint32(0xFFFF))
        out = np.full(pair.shape, _NONE, np.int32)
        for multiplier, key, rank in self.tables:
            slot = (pair * multiplier) >> np.uint32(32 - _SLOTS)
            hit = key[slot] == pair
            out[hit] = rank[slot[hit]]
        out[(one < 0) | (other < 0)] = _NONE
        return out


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        model = json.loads(Path(path).read_text())["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if len(vocab) > 1 << 16 or model["end_of_word_suffix"] != "</w>":
            raise ValueError("needs at most 65,536 ids and a word-end mark </w>")
        pairs = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.uint32)
        self.pairs = PairTable(pairs, np.array([vocab[a + b] for a, b in merges]))
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + "</w>"] for s in symbols], np.int32)
        import regex

        #: Classes of code points under 0x250: 0 white space, 1 letter, 2 number, 3 other.
        self.forget()
        self.kind = np.array([0 if c in (9, 10, 11, 12, 13, 32) else 1 if regex.match(r"\p{L}", chr(c)) else 2 if regex.match(r"\p{N}", chr(c)) else 3 for c in range(0x250)], np.int8)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain: list[int] = []
        for k, text in enumerate(texts):
            if text and ("<|" in text or not text.isascii() and _ODD.search(text)):
                out[k] = self._encode_any(text)
            else:
                plain.append(k)
        lowered = [(texts[k] or "").lower() for k in plain]
        for rows, data, begin in words.chunks(lowered):
            odd = set((np.searchsorted(begin, np.flatnonzero(_CONTROL[data]), "right") - 1).tolist())
            for i, (r, ids) in enumerate(zip(rows, self._encode_plain(data, begin), strict=True)):
                out[plain[r]] = self._encode_any(texts[plain[r]]) if i in odd else ids
        return out

    def _encode_any(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def forget(self) -> None:
        """Drop the words' ids; they are merged again when they come again."""
        size = 1 << CACHE_BITS
        self.known, self.place, self.count = np.zeros(size, np.uint64), np.zeros(size, np.uint32), np.zeros(size, np.uint32)
        self.store, self.stored = np.empty(1 << 16, np.uint32), 0

    def _ids_of(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct pre-tokens lie in the store, and how many they are."""
        slot = (hashes & np.uint64((1 << CACHE_BITS) - 1)).astype(np.int64)
        place, count = self.place[slot].astype(np.int64), self.count[slot].astype(np.int64)
        new = np.flatnonzero(self.known[slot] != hashes)
        if len(new):
            flat, offset = self._merge(data, starts[new], ends[new])
            if self.stored + len(flat) > CACHE_IDS and len(new) < len(hashes):
                self.forget()
                return self._ids_of(data, hashes, starts, ends)
            if self.stored + len(flat) > len(self.store):
                self.store = np.concatenate([self.store[: self.stored], np.empty(self.stored + len(flat), np.uint32)])
            self.store[self.stored : self.stored + len(flat)] = flat
            place[new], count[new] = self.stored + offset[:-1], np.diff(offset)
            self.stored += len(flat)
            self.known[slot[new]], self.place[slot[new]], self.count[slot[new]] = hashes[new], place[new], count[new]
        return place, count

    def _cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """starts and ends of the pre-tokens in the UTF-8 bytes of lower-cased plain texts."""
        kind = self.kind[data & 0x7F]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            kind[lead] = kind[lead + 1] = self.kind[((data[lead].astype(np.int32) & 31) << 6) | (data[lead + 1] & 63)]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = kind[1:] != kind[:-1]
        cut[np.flatnonzero(kind == 2)] = True
        if len(lead):
            cut[lead + 1] = False
        mark = np.flatnonzero(data[:-1] == 39)
        mark = mark[cut[mark] & cut[mark + 1]]
        if len(mark):
            a, b = data[mark + 1], data[np.minimum(mark + 2, len(data) - 1)]
            two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
            one = np.isin(a, [115, 116, 109, 100])
            for m, n in ((mark[one], 1), (mark[two & ~one], 2)):
                cut[m + 1] = False
                cut[m + n + 1] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        keep = kind[starts] != 0
        return starts[keep], ends[keep]

    def _encode_plain(self, data: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
        starts, ends = self._cut(data)
        if not len(starts):
            return [np.empty(0, np.uint32)] * (len(begin) - 1)
        hashes = words.spans_hashes(data, starts, ends)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        where, many = self._ids_of(data, hashes[first], starts[first], ends[first])
        count = many[inverse]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.store[np.repeat(where[inverse] - total[:-1], count) + np.arange(total[-1])]
        place = total[np.searchsorted(starts, begin)]
        return [ids[place[i] : place[i + 1]] for i in range(len(begin) - 1)]

    def _merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, one after another, and where each begins (and one more, for the end)."""
        size = ends - starts
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for high in (4, 8, 12, 16, 24, LONG):
            rows = np.flatnonzero((size > low) & (size <= high))
            low = high
            if len(rows):
                found += self._merge_rows(data, rows, starts[rows], size[rows], high)
        count = np.zeros(len(size), np.int64)
        for rows, _, n in found:
            count[rows] = n
        own = {r: np.array(self.library.encode(data[starts[r] : ends[r]].tobytes().decode(), add_special_tokens=False).ids, np.uint32) for r in np.flatnonzero(size > LONG)}
        for r, ids in own.items():
            count[r] = len(ids)
        offset = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(offset[-1], np.uint32)
        for rows, tokens, n in found:
            inside = np.arange(tokens.shape[1])[None, :] < n[:, None]
            flat[(offset[rows][:, None] + np.arange(tokens.shape[1])[None, :])[inside]] = tokens[inside]
        for r, ids in own.items():
            flat[offset[r] : offset[r + 1]] = ids
        return flat, offset

    def _merge_rows(self, data: np.ndarray, rows: np.ndarray, starts: np.ndarray, size: np.ndarray, wide: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        column = np.arange(wide)
        inside = column[None, :] < size[:, None]
        place = np.where(inside, starts[:, None] + column[None, :], 0)
        tokens = np.where(inside, self.inner[data[place]], -1)
        last = size - 1
        tokens[np.arange(len(rows)), last] = self.final[data[starts + last]]
        ranks = np.full((len(rows), wide), _NONE, np.int32)
        ranks[:, :-1] = self.pairs.rank(tokens[:, :-1], tokens[:, 1:])
        size = size.copy()
        done = []
        while True:
            at = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            best = ranks[line, at]
            more = best < _NONE
            if not more.all():
                done.append((rows[~more], tokens[~more], size[~more]))
                rows, tokens, ranks, size, at, best = rows[more], tokens[more], ranks[more], size[more], at[more], best[more]
                line = np.arange(len(rows))
            if not len(rows):
                return done
            after = column[None, :-1] > at[:, None]
            tokens[:, :-1] = np.where(after, tokens[:, 1:], tokens[:, :-1])
            ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
            size -= 1
            tokens[line, size] = -1
            merged = self.pairs.merged[best]
            tokens[line, at] = merged
            right = tokens[line, np.minimum(at + 1, wide - 1)]
            ranks[line, at] = self.pairs.rank(merged, np.where(at + 1 < size, right, -1))
            has_left = at > 0
            l = line[has_left]
            ranks[l, at[l] - 1] = self.pairs.rank(tokens[l, at[l] - 1], merged[l])


@cache
def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return Encoder(path)
