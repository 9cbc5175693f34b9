"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Short test items are partitioned by the number of their five-word shingles into classes [2^i, 2^(i+1)). An item of a
class keeps its bottom-k MinHash sketch, k fixed by the largest size of the class: k = floor((1 - t) * largest) + 1.
A document that holds at least t of an item misses at most floor((1 - t) * size) of its shingles, so it holds at
least one of the sketch: no contaminated document is missed, however long it is. (Banded signatures of whole
documents can't promise that: 40 shingles within 3,000 have a Jaccard similarity near 0.01.)

A document probes the sketches with the hashes of all its shingles; items that it hits are verified on the
shingles themselves, as strings. Items of at most BLOCK_BYTES of text are one broadcast index, and documents pass it in a
narrow pass. More items are never gathered: their sketches are a table, a bit table of fixed size lets few of a document's
hashes through, those meet the sketches in a join, and each document that hits an item meets the texts of its items once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearstack.llm import words
from clearstack.llm.common import arrow_map, materialize, prepare

WIDTH = 5
#: Bytes of item text in a broadcast index, which takes about four times as much; more items are joined.
BLOCK_BYTES = 4_000_000
_TABLE_BITS = 22
#: Bits of the table that a join's hashes pass: 4 MB, in 2^19 words.
_SIEVE_BITS = 25


def sketch(shingles: set[str], percent: int) -> tuple[int, np.ndarray]:
    """The width of an item's shingles, and the least of their hashes: so many that a document holding the item has one of them."""
    width = next(iter(shingles)).count(" ") + 1
    some = np.sort(np.concatenate([words.shingle_hashes(w, width) for w in words.texts_word_hashes(list(shingles))]))
    largest = (1 << len(some).bit_length()) - 1
    return width, some[: (100 - percent) * largest // 100 + 1]


def contained(text: str | None, items: list[tuple[int, set[str]]], percent: int) -> list[tuple[int, float]]:
    """The items (item_id, shingles) that the text holds, with the shares of their shingles in it."""
    rows = []
    sets: dict[int, set[str]] = {}
    for item, shingles in items:
        width = next(iter(shingles)).count(" ") + 1
        if width not in sets:
            sets[width] = words.plain_shingles(text, width)
        both = len(shingles & sets[width])
        if 100 * both >= percent * len(shingles):
            rows.append((item, both / len(shingles)))
    return rows


def best(found: list[tuple[int, float]]) -> tuple[int, int | None, float]:
    """How many items, and the one with the greatest share, the smallest id on ties."""
    if not found:
        return 0, None, 0.0
    item, share = min(found, key=lambda x: (-x[1], x[0]))
    return len(found), item, share


class ItemIndex:
    """Sketches of items, and the shingles to verify with."""

    def __init__(self, items: list[tuple[int, str | None]], percent: int = 75) -> None:
        self.percent = percent
        self.items = [(i, s) for i, s in ((i, words.plain_shingles(t, WIDTH)) for i, t in sorted(items, key=lambda x: x[0])) if s]
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, (_, shingles) in enumerate(self.items):
            width, some = sketch(shingles, percent)
            parts.setdefault(width, []).append((some, np.full(len(some), k)))
        for width, pairs in parts.items():
            h, o = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[h >> np.uint64(64 - _TABLE_BITS)] = True
            self.by_width[width] = (h[order], o[order], table)

    def search(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        """For each text the items (item_id, containment) that it holds, by item_id."""
        out = []
        for text, w in zip(texts, words.texts_word_hashes(texts), strict=True):
            found: set[int] = set()
            for width, (keys, owner, table) in self.by_width.items():
                h = words.shingle_hashes(w, width) if len(w) >= width else np.empty(0, np.uint64)
                h = h[table[h >> np.uint64(64 - _TABLE_BITS)]]
                if len(h):
                    left, right = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
                    for a, b in zip(left[left < right], right[left < right], strict=True):
                        found.update(owner[a:b].tolist())
            out.append(contained(text, [self.items[k] for k in sorted(found)], self.percent))
        return out


def _usable(items: DataFrame) -> DataFrame:
    return items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")


def broadcast_index(items: DataFrame, percent: int = 75) -> Broadcast | None:
    """An index over items (item_id, text); None where their texts have more than BLOCK_BYTES."""
    spark = items.sparkSession
    prepare(spark)
    items = _usable(items)
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return None if size > BLOCK_BYTES else spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in items.collect()], percent))


def _sieve(sketches: DataFrame) -> np.ndarray:
    """Words of a bit table of the sketches' hashes: at most 2^19 words reach the driver, however many the items."""
    slot = F.shiftrightunsigned("hash", 64 - _SIEVE_BITS)
    word = F.shiftrightunsigned(slot, 6).alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    out = np.zeros(1 << (_SIEVE_BITS - 6), np.uint64)
    for r in sketches.groupBy(word).agg(F.bit_or(bit).alias("bits")).collect():
        out[r.word] = np.uint64(r.bits & (1 << 64) - 1)
    return out


def held_items(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, text_key, n_items, item_id and containment of the rows of docs that hold an item, by joins: for items of any number.

    Rows that repeat both doc_id and text are answered once.
    """
    spark = docs.sparkSession
    items = materialize(_usable(items), "items")

    def sketched(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"item_id": [], "text": [], "width": [], "hashes": []}
        for i, t in zip(b["item_id"], b["text"], strict=True):
            shingles = words.plain_shingles(t, WIDTH)
            if shingles:
                width, some = sketch(shingles, percent)
                for k, v in zip(out, (i, t, width, some.view(np.int64).tolist()), strict=True):
                    out[k].append(v)
        return out

    known = materialize(arrow_map(items, sketched, "item_id long, text string, width int, hashes array<bigint>"), "sketches")
    sketches = known.select("item_id", F.xxhash64("text").alias("item_key"), "width", F.explode("hashes").alias("hash")).distinct()
    sieve = spark.sparkContext.broadcast(_sieve(sketches))
    widths = [r[0] for r in known.select("width").distinct().orderBy("width").collect()]  # at most WIDTH

    def probes(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": [], "text_key": [], "width": [], "hashes": []}
        for i, key, w in zip(b["doc_id"], b["text_key"], words.texts_word_hashes(b["text"]), strict=True):
            for width in widths:
                h = np.unique(words.shingle_hashes(w, width)) if len(w) >= width else np.empty(0, np.uint64)
                slot = h >> np.uint64(64 - _SIEVE_BITS)
                h = h[(sieve.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)]
                if len(h):
                    for k, v in zip(out, (i, key, width, h.view(np.int64).tolist()), strict=True):
                        out[k].append(v)
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    probed = arrow_map(rows.select("doc_id", "text_key", "text"), probes, "doc_id long, text_key long, width int, hashes array<bigint>")
    hits = probed.select("doc_id", "text_key", "width", F.explode("hashes").alias("hash")).join(sketches, ["width", "hash"])
    hits = materialize(hits.select("doc_id", "text_key", "item_id", "item_key").distinct(), "hits")
    texts = known.select("item_id", F.xxhash64("text").alias("item_key"), F.col("text").alias("item_text")).distinct()
    per = hits.join(texts, ["item_id", "item_key"]).groupBy("doc_id", "text_key").agg(F.collect_list("item_id").alias("items"), F.collect_list("item_text").alias("item_texts"))
    same = (rows["doc_id"].eqNullSafe(F.col("own_id"))) & (rows["text_key"] == F.col("own_key"))
    met = rows.join(per.withColumnsRenamed({"doc_id": "own_id", "text_key": "own_key"}), same).select("doc_id", "text_key", "text", "items", "item_texts")

    def verified(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "text_key", "n_items", "item_id", "containment")}
        for i, key, text, ids, texts in zip(b["doc_id"], b["text_key"], b["text"], b["items"], b["item_texts"], strict=True):
            found = best(contained(text, [(k, words.plain_shingles(t, WIDTH)) for k, t in zip(ids, texts, strict=True)], percent))
            if found[0]:
                for k, v in zip(out, (i, key, *found), strict=True):
                    out[k].append(v)
        return out

    return materialize(arrow_map(met, verified, "doc_id long, text_key long, n_items long, item_id long, containment double").distinct(), "held-items")


def _with_finds(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    found = found.withColumnsRenamed({"doc_id": "found_id", "text_key": "found_key"})
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["found_id"]) & (F.xxhash64(docs["text"]) == found["found_key"]), how)


def uncontaminated(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs whose texts hold no item; all columns stay, null texts hold none."""
    index = broadcast_index(items, percent)
    if index is None:
        return _with_finds(docs, held_items(docs, items, percent), "left_anti")

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([not x for x in index.value.search(text.tolist())], dtype=bool)

    return docs.where(clean(F.col("text")))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """For each row of docs (doc_id, text): contaminated, n_items, item_id and containment of the item it holds most of.

    An item counts where the document holds at least percent of its distinct five-word shingles; an item of fewer
    words is one shingle, found where the document has these words in a row. Of items with equal containment the
    smallest item_id is reported; item_id is null and containment 0 where there is none. Null and empty texts hold nothing; items
    without words or with a null id are ignored; repeated rows are each answered; empty tables give no rows or no finds.
    """
    docs = docs.select("doc_id", "text")
    index = broadcast_index(items, percent)
    if index is None:
        rows = _with_finds(docs, held_items(docs, items, percent).withColumnsRenamed({"item_id": "item"}), "left").select("doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("item").alias("item_id"), F.coalesce("containment", F.lit(0.0)).alias("containment"))
    else:

        def run(b: dict[str, list]) -> dict[str, list]:
            b["n_items"], b["item_id"], b["containment"] = (list(c) for c in zip(*map(best, index.value.search(b.pop("text"))), strict=True)) if b["doc_id"] else ([], [], [])
            return b

        rows = arrow_map(docs, run, "doc_id long, n_items long, item_id long, containment double")
    return rows.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_id", "containment")
