"""Language identification with hyperdimensional profiles.

Each of 128 letter slots (0 is the gap between words) has a random vector of +1 and -1 in DIMENSIONS dimensions. The
vector of a letter trigram binds, by product, its letters' vectors rotated by their places; a text's profile bundles, by
sum, the vectors of its trigrams, and a language's prototype those of its training texts. A text gets the language
whose prototype has the greatest cosine with its profile.

Bundling is linear, so a batch counts trigrams first and multiplies counts by the trigram vectors that occur. Training
sums vectors within each partition, then by language and dimension; the driver gets DIMENSIONS numbers a language, of
which there may be MAX_LANGUAGES. Prediction is narrow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearstack.llm import words
from clearstack.llm.common import arrow_map, arrow_stream, held_out

DIMENSIONS = 1024
MAX_LANGUAGES = 1000
UNKNOWN = "und"
#: Letters that are counted at once; a longer text is counted in parts, whole.
_PART = 1 << 21
#: Cells of the table of groups by distinct trigrams (12 bytes each): more groups than fit are taken in parts.
_CELLS = 1 << 23


def _letter_slots() -> np.ndarray:
    """Slots of code points under 0x10000: 0 for what is no letter, 1-26 for a-z, others by a hash."""
    slots = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if chr(c).isalpha():
            slots[c] = c - 96 if 97 <= c <= 122 else 27 + c * 40503 % 65536 % 101
    return slots


_SLOTS = _letter_slots()
_LETTERS = np.where(words.mix(np.arange(1, 128 * DIMENSIONS + 1, dtype=np.uint64)) >> np.uint64(63), 1, -1).astype(np.int8).reshape(128, DIMENSIONS)
_PLACED = [np.roll(_LETTERS, 2, axis=1), np.roll(_LETTERS, 1, axis=1), _LETTERS]


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    return (_PLACED[0][codes >> 14] * _PLACED[1][codes >> 7 & 127] * _PLACED[2][codes & 127]).astype(np.float32)


def trigrams(text: str | None) -> np.ndarray:
    """Codes of the trigrams of a whole text, lower-cased, with one gap between words and at both ends; none without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    slots = _SLOTS[np.where(points < 1 << 16, points, 0)].astype(np.int32)
    far = points >= 1 << 16
    if far.any():
        slots[far] = [27 + int(p) * 40503 % 65536 % 101 if chr(p).isalpha() else 0 for p in points[far]]
    if not slots.any():
        return np.empty(0, np.int32)
    slots = np.concatenate([[0], slots, [0]])
    slots = slots[np.concatenate([[True], (slots[1:] != 0) | (slots[:-1] != 0)])]
    return slots[:-2] << 14 | slots[1:-1] << 7 | slots[2:]


def bundles(groups: list[int], codes: list[np.ndarray], n: int) -> np.ndarray:
    """The sum of the trigram vectors of each of n groups; codes[k] belongs to group groups[k]."""
    out = np.zeros((n, DIMENSIONS), np.float64)
    i = 0
    while i < len(codes):
        j, size = i, 0
        while j < len(codes) and (j == i or size + len(codes[j]) <= _PART):
            size += len(codes[j])
            j += 1
        part = np.concatenate(codes[i:j])
        owner = np.repeat(np.array(groups[i:j], np.int64), [len(c) for c in codes[i:j]])
        for p in range(0, len(part), _PART):
            _bundle(out, owner[p : p + _PART], part[p : p + _PART])
        i = j
    return out


def _bundle(out: np.ndarray, owner: np.ndarray, codes: np.ndarray) -> None:
    """Adds trigrams to their groups; owners ascend. Of scripts with many letters, few groups make a table at a time."""
    if not len(codes):
        return
    seen = np.bincount(codes, minlength=1 << 21) > 0
    distinct = np.flatnonzero(seen)
    low = int(owner[0])
    rows = int(owner[-1]) - low + 1
    if rows > 1 and rows * len(distinct) > _CELLS:
        cut = int(np.searchsorted(owner, low + rows // 2))
        _bundle(out, owner[:cut], codes[:cut])
        _bundle(out, owner[cut:], codes[cut:])
        return
    place = np.cumsum(seen, dtype=np.int32) - 1
    counts = np.bincount((owner - low) * len(distinct) + place[codes], minlength=rows * len(distinct)).reshape(rows, -1).astype(np.float32)
    for k in range(0, len(distinct), 4096):
        out[low : low + rows] += counts[:, k : k + 4096] @ trigram_vectors(distinct[k : k + 4096])


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes by language, from the texts and non-null languages of rows that held_out() leaves."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names = sorted(set(b["lang"]))
            at = sorted((names.index(lang), k) for k, lang in enumerate(b["lang"]))
            got = bundles([g for g, _ in at], [trigrams(b["text"][k]) for _, k in at], len(names))
            for name, v in zip(names, got, strict=True):
                sums[name] = sums.get(name, 0) + v
        yield {"lang": list(sums), "profile": [np.rint(v).astype(np.int64) for v in sums.values()]}

    rows = docs.where("lang is not null and text is not null").where(~held_out()).select("lang", "text")
    parts = arrow_stream(rows, run, "lang string, profile array<bigint>")
    summed = parts.select("lang", F.posexplode("profile").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    got: dict[str, np.ndarray] = {}
    for lang, at, v in summed.orderBy("lang", "at").limit((MAX_LANGUAGES + 1) * DIMENSIONS).collect():
        got.setdefault(lang, np.zeros(DIMENSIONS))[at] = v
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {k: v for k, v in got.items() if v.any()}


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, at least 0) of each row of docs (doc_id, text, lang).

    A text that is null or has no letter is `und` with score 0, as is every text if there is nothing to learn from.
    Of equal cosines the first language by name wins. Rows that repeat an id are each answered; an empty table gives no rows.
    """
    prototypes = train(docs)
    names = sorted(prototypes)
    units = np.array([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]).reshape(len(names), DIMENSIONS)

    def run(b: dict[str, list]) -> dict[str, list]:
        codes = [trigrams(t) for t in b.pop("text")]
        vectors = bundles(list(range(len(codes))), codes, len(codes))
        norms = np.linalg.norm(vectors, axis=1)
        near = vectors @ units.T / np.maximum(norms, 1e-9)[:, None] if names else np.zeros((len(codes), 1))
        known = (np.array([len(c) for c in codes]) > 0) & bool(names)
        best = near.argmax(axis=1)
        b["lang_pred"] = [names[best[k]] if known[k] else UNKNOWN for k in range(len(codes))]
        b["score"] = [float(min(1.0, max(0.0, near[k, best[k]]))) if known[k] else 0.0 for k in range(len(codes))]
        return b

    return arrow_map(docs.select("doc_id", "text", held_out().alias("held_out")), run, "doc_id long, held_out boolean, lang_pred string, score double")
