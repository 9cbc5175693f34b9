"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, weighted by their counts. Each of SAMPLES samples draws, for a term, r and c from
Gamma(2, 1) and b from the unit interval; with t = floor(ln(weight) / r + b) the term's value is
ln a = ln c - r * (t - b) - r, and the least value wins. Two texts draw the same (term, t) with a probability equal to
the generalised Jaccard similarity of their weights, so the share of equal samples estimates it (standard deviation
at most 0.045). A sample is kept as 16 bits of a hash of the winner's value, which stands for (term, t).

The draws of a word follow from its whole 64-bit hash, so different words have different draws (but for equal hashes,
about 1 in 2^64 a pair), equal everywhere. A worker keeps the draws of words seen lately in tables of a fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearstack.llm import words
from clearstack.llm.common import BATCH_ROWS, arrow_stream, partitions_for, prepare

SAMPLES = 128
#: Tables of 2^17 words for weight 1 and of 2^15 words for other weights: 67 MB and 50 MB a worker.
ONE_BITS, MORE_BITS = 17, 15
#: Rows of one partition in the pass that sees neighbours; about 65 MB of text at the usual 3 KB a document.
PARTITION_ROWS = 20_000
_BLOCK = 512
_KEYS = words.mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64)).reshape(2, SAMPLES) | np.uint64(1)


def _halves(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit values by word and sample: the hash times the sample's odd key, mixed."""
    x = hashes[:, None] * keys
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(29)
    return x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)


def _unit(v: np.ndarray) -> np.ndarray:
    """23-bit numbers as the middles of as many steps of the unit interval, never 0 or 1; in 32-bit numbers."""
    v = v << np.uint32(1)
    v |= np.uint32(1)
    out = v.view(np.int32).astype(np.float32)
    out *= np.float32(2**-24)
    return out


def _gamma_log(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Gamma(2, 1) from two uniforms: less the logarithm of their product."""
    out = _unit(one >> np.uint32(9))
    out *= _unit(other >> np.uint32(9))
    np.log(out, out=out)
    return np.negative(out, out=out)


def _parts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, b and ln c of words by word and sample: five 23-bit uniforms out of four 32-bit values."""
    (x, y), (v, w) = (_halves(hashes, k) for k in _KEYS)
    low = np.uint32(511)
    b = _unit((x & low) << np.uint32(14) | (y & low) << np.uint32(5) | v & np.uint32(31))
    c = _gamma_log(v, w)
    return _gamma_log(x, y), b, np.log(c, out=c)


def _draws(hashes: np.ndarray) -> np.ndarray:
    return np.stack(_parts(hashes), axis=1)


def _at_one(hashes: np.ndarray) -> np.ndarray:
    """The values of words at weight 1, by word and sample."""
    r, b, lnc = _parts(hashes)
    return lnc - r * (1 - b)


class _Table:
    """What draw gives for words, kept for the last word of each slot; a word is known by its whole hash."""

    def __init__(self, bits: int, draw: Callable[[np.ndarray], np.ndarray]) -> None:
        self.shift, self.draw = np.uint64(64 - bits), draw
        self.tags = ~(np.arange(1 << bits, dtype=np.uint64) << self.shift)  # of no word in that slot
        self.rows = np.empty((1 << bits, *draw(np.zeros(1, np.uint64)).shape[1:]), np.float32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        slots = (hashes >> self.shift).astype(np.int64)
        out = self.rows[slots]
        new = np.flatnonzero(self.tags[slots] != hashes)
        if len(new):
            out[new] = self.draw(hashes[new])
            # Of words that share a slot the last stays, in both.
            self.rows[slots[new]], self.tags[slots[new]] = out[new], hashes[new]
        return out


@cache
def _tables() -> tuple[_Table, _Table]:
    return _Table(ONE_BITS, _at_one), _Table(MORE_BITS, _draws)


def weights_signature(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SAMPLES 16-bit samples of positive weights over distinct 64-bit word hashes; zeros where there are none."""
    if not len(terms):
        return np.zeros(SAMPLES, np.uint16)
    ones, others = _tables()
    least = np.full(SAMPLES, np.inf, np.float32)
    single, more = terms[weights == 1], np.flatnonzero(weights != 1)
    for i in range(0, len(single), _BLOCK):
        np.minimum(least, ones.of(single[i : i + _BLOCK]).min(axis=0), out=least)
    for i in range(0, len(more), _BLOCK):
        m = more[i : i + _BLOCK]
        r, b, lnc = others.of(terms[m]).swapaxes(0, 1)
        t = np.floor(np.log(weights[m]).astype(np.float32)[:, None] / r + b)
        np.minimum(least, (lnc - r * (t - b + 1)).min(axis=0), out=least)
    return (words.mix(least.view(np.uint32).astype(np.uint64) + np.uint64(1)) >> np.uint64(48)).astype(np.uint16)


def signatures(texts: list[str | None]) -> list[np.ndarray]:
    """The samples of each whole text; equal texts have equal samples, a text without words (or null) all zeros."""
    out = []
    for h in words.texts_word_hashes(texts):
        out.append(weights_signature(*np.unique(h, return_counts=True)))
    return out


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    return float((one == other).mean())


#: Rows in order: ids that are not null first, then by id, and rows of one id by a hash of their texts.
_ORDER = ("none", "key", "turn")


class _Cuts:
    """The first rows of the ranges that rows are dealt to: three numbers for each range, in order."""

    def __init__(self, rows: list[tuple[int, int, int]]) -> None:
        rows = sorted(rows)
        self.nulls = sum(r[0] == 0 for r in rows)  # from here on come the rows with null ids
        self.keys = np.array([r[1] for r in rows], np.int64)
        self.turns = np.array([r[2] for r in rows], np.int64)

    def places(self, none: np.ndarray, key: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of each row, and whether it begins that range."""
        n, at = len(self.keys), self.nulls
        end = np.where(none == 1, at + np.searchsorted(self.turns[at:], turn, "right"), np.searchsorted(self.keys[:at], key, "right"))
        begin = np.searchsorted(self.keys[:at], key, "left")
        # Of an id that begins ranges, its rows are told apart by their hashes; there is one such cut, or the id repeats.
        for k in np.flatnonzero((none == 0) & (begin < end)):
            end[k] = begin[k] + np.searchsorted(self.turns[begin[k] : end[k]], turn[k], "right")
        place = np.clip(end - 1, 0, n - 1)
        first = (none == (place >= at)) & (self.keys[place] == key) & (self.turns[place] == turn)
        return place, first


def _neighbours(docs: DataFrame) -> DataFrame:
    """copy, doc_id, text: in each partition, in order, every row but a copy stands before the next document.

    A pass over ids alone finds ranges of about PARTITION_ROWS rows, and the driver gets the first row of each as three
    numbers. Rows go to the partition of their range, so all texts are shuffled once; the first row of a range is copied
    to the end of the range before (that of the first range to the last). Rows with null ids are dealt by their texts.
    """
    spark = docs.sparkSession
    prepare(spark)
    id_, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    docs = docs.select(F.when(id_.isNull(), 1).otherwise(0).alias("none"), F.coalesce(id_, F.lit(0).cast("long")).alias("key"), F.xxhash64(text).alias("turn"), id_.alias("doc_id"), text.alias("text"))
    parts = partitions_for(spark, docs.count(), PARTITION_ROWS)
    ranges = docs.select(*_ORDER).repartitionByRange(parts, *_ORDER)
    heads = ranges.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct(*_ORDER)).alias("head")).select("head.*").collect()
    if not heads:
        return docs.select(F.lit(0).alias("copy"), "doc_id", "text")
    cuts, last = spark.sparkContext.broadcast(_Cuts([tuple(r) for r in heads])), len(heads) - 1

    @F.pandas_udf("place int, before int")
    def dealt(none: pd.Series, key: pd.Series, turn: pd.Series) -> pd.DataFrame:
        place, first = cuts.value.places(none.to_numpy(), key.to_numpy(), turn.to_numpy())
        before = np.where(place > 0, place - 1, last)
        return pd.DataFrame({"place": place.astype(np.int32), "before": pd.Series(before).where(first).astype("Int32")})

    rows = docs.withColumn("d", dealt(*_ORDER))
    own = F.struct(F.col("d.place").alias("place"), F.lit(0).alias("copy"))
    copy = F.struct(F.col("d.before").alias("place"), F.lit(1).alias("copy"))
    places = F.when(F.col("d.before").isNull(), F.array(own)).otherwise(F.array(own, copy))
    rows = rows.select(*_ORDER, "doc_id", "text", F.explode(places).alias("p")).select("p.place", "p.copy", *_ORDER, "doc_id", "text")
    return rows.repartitionById(last + 1, "place").sortWithinPartitions("copy", *_ORDER, "text").select("copy", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """text with its last half, rounded down, replaced by as many (or all) first code points of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text) its fingerprint, that of its edited text, and likenesses.

    The next document is the one that follows by doc_id (rows that repeat an id, and those with null ids, which come last: by a hash of the text); after the
    last comes the first, and a single document is its own next. Null texts count as empty; two texts without words
    are alike by 1, one without words and one with by 0. An empty table gives no rows.
    """

    def answer(rows: list[tuple]) -> dict[str, list]:
        """rows: (copy, doc_id, text) of one range; all but copies are answered, if another follows."""
        kept = [k for k in range(len(rows) - 1) if not rows[k][0]]
        own = signatures([r[2] for r in rows])
        texts = [edited(rows[k][2], rows[k + 1][2]) for k in kept]
        other = signatures(texts)
        out: dict[str, list] = {"doc_id": [rows[k][1] for k in kept], "n_chars": [len(rows[k][2]) for k in kept]}
        out["edited_sha256"] = [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in texts]
        out["fingerprint"] = [own[k].astype(">u2").tobytes().hex() for k in kept]
        out["edited_fingerprint"] = [e.astype(">u2").tobytes().hex() for e in other]
        out["near_edited"] = [likeness(own[k], e) for k, e in zip(kept, other, strict=True)]
        out["near_next"] = [likeness(own[k], own[k + 1]) for k in kept]
        return out

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        rows: list[tuple] = []
        for b in batches:
            rows += zip(b["copy"], b["doc_id"], b["text"], strict=True)
            if len(rows) > BATCH_ROWS // 2:
                yield answer(rows)
                rows = rows[-1:]
        yield answer(rows)

    return arrow_stream(_neighbours(docs), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
