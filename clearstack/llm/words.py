"""Words and word shingles of whole texts as 64-bit hashes, computed over byte arrays with numpy.

A word is a maximal run without the ASCII white space 0x09-0x0D and 0x20, with A-Z lower-cased; other letters stay.
The hash of a word is a polynomial in an odd base over random 64-bit values of its bytes, then mixed; that of a
shingle mixes the hashes of its words by position. Equal words have equal hashes in every process and version.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)
#: Bytes of text that are hashed at once, which takes about 50 bytes each; a longer text is hashed alone, whole.
CHUNK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection that spreads every bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_ODD))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = mix(np.arange(1, 65, dtype=U)) | U(1)
_powers = [np.empty(0, U), np.empty(0, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        for i, base in enumerate((_ODD, _INVERSE)):
            p = np.full(size, U(base), U)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=U)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends and hashes of the words in an array of bytes."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U)
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, spans_hashes(data, starts, ends)


def spans_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of an array of bytes."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def chunks(texts: list[str | None]) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Rows, their bytes joined by a space, and where each begins (and one more, for the end), in chunks."""
    i = 0
    while i < len(texts):
        parts, size, j = [], 0, i
        while j < len(texts) and (j == i or size < CHUNK):
            parts.append((texts[j] or "").encode("utf-8", "replace"))
            size += len(parts[-1]) + 1
            j += 1
        data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
        yield range(i, j), data, np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        i = j


def texts_word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order."""
    for rows, data, begin in chunks(texts):
        starts, _, h = word_hashes(data)
        cut = np.searchsorted(starts, begin)
        for k in range(len(rows)):
            yield h[cut[k] : cut[k + 1]]


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the shingles in order, repeats included; of fewer words than width, the whole sequence as one."""
    n = len(words)
    if not n:
        return np.empty(0, U)
    w = min(n, width)
    out = np.full(n - w + 1, U(w), U)
    for k in range(w):
        out += words[k : n - w + 1 + k] * _PLACE[k]
    return mix(out)


def texts_shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; empty for a text without words, or null."""
    for words in texts_word_hashes(texts):
        yield np.unique(shingle_hashes(words, width))


def plain_words(text: str | None) -> list[str]:
    """The words themselves, for exact checks of single texts."""
    return (text or "").translate(_LOWER).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if text else []


_LOWER = {c: c + 32 for c in range(65, 91)}


def plain_shingles(text: str | None, width: int = 5) -> set[str]:
    """The distinct shingles themselves, words joined by a space."""
    words = [w for w in plain_words(text) if w]
    if not words:
        return set()
    w = min(len(words), width)
    return {" ".join(words[i : i + w]) for i in range(len(words) - w + 1)}
