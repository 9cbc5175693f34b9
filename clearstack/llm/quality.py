"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Words are runs of letters and digits, and runs of the same punctuation mark, as they are written. Features are hashed
to DIMENSIONS: single words and pairs of neighbours, and pairs and triples of word shapes (case, length class,
punctuation mark, whether the word before is the same), so that invented words tell something too. A text's vector has
the share of each feature among all of the text's, times SCALE; its score is the logistic of a sparse dot product.

FTRL-proximal keeps two numbers a weight and sees the sample once an epoch, in one task, over a bounded sample of
labelled rows; the weights (DIMENSIONS * 4 bytes) go to all tasks, and scoring is narrow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearstack.llm import words
from clearstack.llm.common import arrow_map, arrow_stream, held_out, least_hashed, prepare

DIMENSIONS = 1 << 18
#: Labelled rows that are learned from at most, by least hash of doc_id.
SAMPLE_ROWS = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-6
SCALE = 20.0
REJECT_UNDER = 0.3

_CLASS = np.full(256, 5, np.uint8)  # 0 space, 1 lower, 2 upper, 3 digit, 4 line end, 5 mark, 6 beyond ASCII
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_KIND = np.array([0, 1, 1, 1, 0, 2, 1], np.uint8)


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each whole text the indexes of its features, one for each occurrence."""
    for rows, data, begin in words.chunks(texts):
        kind = _KIND[_CLASS[data]]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) & (data[1:] != data[:-1])
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        keep = kind[starts] != 0
        starts, ends = starts[keep], ends[keep]
        cls = _CLASS[data]
        # words.spans_hashes folds case; the share of capitals, kept in the shape, tells it apart again.
        own = words.spans_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
        upper = np.concatenate([[0], np.cumsum(cls == 2)])
        digit = np.concatenate([[0], np.cumsum(cls == 3)])
        n, up, dg = ends - starts, upper[ends] - upper[starts], digit[ends] - digit[starts]
        case = np.where(up == 0, 0, np.where(up == 1, np.where(cls[starts] == 2, 1, 2), np.where(up * 2 > n, 3, 2)))
        shape = case + 4 * np.minimum(n.astype(np.int64), 24) // 4 * 4 + 128 * np.minimum(dg, 3)
        mark = kind[starts] == 2
        shape = np.where(mark, 1024 + data[starts].astype(np.int64) * 4 + np.minimum(n, 3), shape)
        cut = np.searchsorted(starts, begin)
        for k in range(len(rows)):
            h, s = own[cut[k] : cut[k + 1]], shape[cut[k] : cut[k + 1]].astype(np.uint64)
            if not len(h):
                yield np.empty(0, np.int64)
                continue
            h = h + s * np.uint64(0x9E3779B97F4A7C15)
            same = np.zeros(len(h), np.uint64)
            same[1:] = (h[1:] == h[:-1]).astype(np.uint64)
            s = s * np.uint64(2) + same
            parts = [h, h[1:] * np.uint64(3) + h[:-1] + np.uint64(1), s[1:] * np.uint64(1 << 20) + s[:-1] + np.uint64(1 << 50), s[2:] * np.uint64(1 << 40) + s[1:-1] * np.uint64(1 << 20) + s[:-2] + np.uint64(1 << 62)]
            yield (words.mix(np.concatenate(parts)) >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int64)


class Ftrl:
    """FTRL-proximal for logistic loss; the last weight is the bias."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (logistic(float(w @ x)) - label) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def logistic(v: float) -> float:
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


def counted(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct features in ascending order and how often each occurs, in the least types that hold them."""
    at, count = np.unique(index, return_counts=True)
    return at.astype(np.int32), count.astype(np.min_scalar_type(count.max(initial=0)))


def vector(at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a text's vector isn't zero, the bias last, and its values."""
    return np.append(at, DIMENSIONS), np.append(SCALE * count.astype(np.int64) / max(1, int(count.sum(dtype=np.int64))), 1.0)


def learned(batches: Iterator[dict[str, list]]) -> np.ndarray:
    """Weights from all rows (turn, doc_id, text, quality), kept as counted features, about five bytes each.

    Rows are seen by turn, doc_id and quality, then by their features.
    """
    seen = []
    for b in batches:
        seen += [(t, i, q, *counted(f)) for t, i, q, f in zip(b["turn"], b["doc_id"], b["quality"], features(b["text"]), strict=True)]
    b = None
    seen.sort(key=itemgetter(0, 1, 2))
    for _, alike in groupby(range(len(seen)), key=lambda k: seen[k][:3]):
        k = list(alike)
        if len(k) > 1:
            seen[k[0] : k[-1] + 1] = sorted(seen[k[0] : k[-1] + 1], key=lambda r: np.append(r[3], DIMENSIONS).tobytes())
    model = Ftrl()
    for _ in range(EPOCHS):
        for _, _, q, *f in seen:
            model.learn(*vector(*f), q)
    return model.weights(slice(None)).astype("<f4")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights learned from docs (doc_id, text) with labels (doc_id, quality), only rows that held_out() leaves.

    Labels are taken, and rows seen, in the order of a hash of doc_id; at most sample_rows of each, also where ids repeat.
    Null labels and texts are left out; of an id that is labelled repeatedly each pair counts. Without rows all weights
    are 0 and every score 0.5.
    """
    few = labels.where("quality is not null and doc_id is not null").where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    few = least_hashed(few, "doc_id", sample_rows, "quality").withColumn("turn", F.xxhash64("doc_id"))
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(few), "doc_id").select("turn", "doc_id", "text", "quality", F.xxhash64("doc_id", "text").alias("pick"))
    rows = least_hashed(rows, "pick", sample_rows, "doc_id", "quality")

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        yield {"weights": [learned(batches).tobytes()]}

    got = arrow_stream(rows.repartition(1), run, "weights binary").first()
    return np.frombuffer(got[0], "<f4") if got else np.zeros(DIMENSIONS + 1, "<f4")


def scores(texts: list[str | None], weights: np.ndarray) -> list[float]:
    out = []
    for index in features(texts):
        v = float(weights[index].sum(dtype=np.float64)) * SCALE / max(1, len(index)) + float(weights[-1])
        out.append(float(logistic(v)))
    return out


def quality_score(weights: np.ndarray, text: Column | str) -> Column:
    """A column with the score of each text, 0 to 1; null and empty texts get the bias alone."""

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(scores([x if isinstance(x, str) else None for x in s], weights), dtype=float)

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = REJECT_UNDER) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs (doc_id, text).

    Null and empty texts score by the bias alone; a null doc_id stays null, and is not held out. Rows that repeat an id
    are each scored by their own text, equal texts equally; a score at the threshold is predicted 1. Other columns are not
    read, an empty table gives no rows, and without labels every score is 0.5.
    """
    prepare(docs.sparkSession)
    weights = train(docs, labels)

    def run(b: dict[str, list]) -> dict[str, list]:
        b["score"] = scores(b.pop("text"), weights)
        return b

    rows = arrow_map(docs.select("doc_id", "text", held_out().alias("held_out")), run, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
