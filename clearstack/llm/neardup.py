"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents whose sets of five-word shingles have Jaccard similarity of 0.75 or more are linked, and linked documents
form classes. The plan, none of whose steps emits all pairs of a group:

1. One narrow pass gives each document its set size, a 128-bit key of the set and 128 MinHash values. Documents with
   equal sets collapse to a representative, with partial aggregation, so thousands of copies cost one row each.
2. Representatives meet in 32 bands of 4 values (a pair at 0.75 shares no band with probability 5e-6). In each bucket
   the members are compared with one leader only: pairs grow linearly with the members.
3. A pair's signatures are compared 16 values at a time. With m of n equal and a uniform prior, the posterior of
   the similarity is Beta(m + 1, n - m + 1); the pair is dropped as soon as P(J >= 0.75) falls under MISS.
4. Survivors are confirmed on their full shingle sets, and connected components are taken.
5. Buckets that still hold several components are compared within one task each, across components only, each pair in
   the first band that it shares; buckets over BUCKET by pairs of blocks, one task each. Survivors are confirmed in the
   task, on full sets; only links that join two components leave it. The components are then taken again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearstack.llm import words
from clearstack.llm.common import arrow_map, arrow_stream, discard, materialize

HASHES, ROWS, STEP = 128, 4, 16
BANDS = HASHES // ROWS
#: A pair is dropped where its similarity reaches the threshold with less than this probability.
MISS = 1e-6
#: A bucket of at most so many members, and of so many bytes of text, is compared in one task, a larger one by pairs of blocks.
BUCKET = 512
BLOCK_BYTES = 1 << 24
#: Up to so many keys of texts (24 MB) are broadcast to pick texts; beyond it a shuffle join picks them.
BROADCAST_IDS = 1_000_000
MAX_ROUNDS = 60

_A = (words.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (words.mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """128 MinHash values of a set of 64-bit hashes, in blocks of 2048 so that a long text takes no more memory."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 2048):
        np.minimum(out, (_A[:, None] * h[None, i : i + 2048] + _B[:, None]).min(axis=1), out=out)
    return out


@cache
def least_matches(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """For n = 16, 32, ... compared values the least number of equal ones with P(J >= threshold) >= miss.

    With a uniform prior that probability is P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        p, m = 0.0, -1
        while p < miss:
            m += 1
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def plausible(one: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two arrays of signatures survive every batch of the sequential test."""
    alive, matches = np.arange(len(one)), np.zeros(len(one), np.int64)
    for k, least in enumerate(least_matches(threshold)):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (one[alive, part] == other[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text_bytes, n_shingles, set_key (null for an empty set) and sig (128 little-endian 32-bit values) of each row."""

    def run(b: dict[str, list]) -> dict[str, list]:
        n, key, sig = [], [], []
        for s in words.texts_shingle_sets(b["text"]):
            n.append(len(s))
            key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig.append(minhash(s).tobytes() if len(s) else None)
        return {"doc_id": b["doc_id"], "text_key": b["text_key"], "text_bytes": b["text_bytes"], "n_shingles": n, "set_key": key, "sig": sig}

    rows = docs.select("doc_id", text_key(), F.octet_length("text").cast("long").alias("text_bytes"), "text")
    return arrow_map(rows, run, "doc_id long, text_key long, text_bytes long, n_shingles long, set_key binary, sig binary")


def text_key() -> Column:
    """Tells the texts of rows that repeat a doc_id apart."""
    return F.xxhash64("text").alias("text_key")


def representatives(sets: DataFrame) -> DataFrame:
    """node, doc_id, text_key, text_bytes, copies, set_key and sig of each distinct set: its row of least doc_id.

    A node is that doc_id. Where a doc_id is the least of several sets, all but one of them get numbers beyond all ids.
    """
    least = F.min(F.struct("doc_id", "text_key", "text_bytes")).alias("r")
    rows = sets.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(least, F.count("*").alias("copies"), F.first("sig").alias("sig"))
    reps = materialize(rows.select("r.*", "copies", "set_key", "sig", F.col("r.doc_id").alias("node")), "representatives")
    clash = materialize(reps.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("set_key").alias("own")).where("n > 1").select("doc_id", "own"), "repeated-ids")
    if clash.isEmpty():
        return reps
    beyond = reps.agg(F.max("doc_id")).first()[0] + 1
    fresh = F.when(F.col("own") != F.col("set_key"), F.lit(beyond) + F.monotonically_increasing_id()).otherwise(F.col("doc_id"))
    return materialize(reps.drop("node").join(clash, "doc_id", "left").withColumn("node", F.when(F.col("own").isNull(), F.col("doc_id")).otherwise(fresh)).drop("own"), "representatives")


def _sigs(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(-1, HASHES)


def _surviving(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that pass the sequential test on their signatures."""
    one = reps.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    other = reps.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))

    def run(b: dict[str, list]) -> dict[str, list] | None:
        if not b["a"]:
            return None
        keep = plausible(_sigs(b["sig_a"]), _sigs(b["sig_b"]), threshold)
        return {"a": [b["a"][i] for i in keep], "b": [b["b"][i] for i in keep]}

    return arrow_map(pairs.join(other, "b").join(one, "a"), run, "a long, b long")


def _texts(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of some nodes; of few nodes a broadcast picks the texts, so others aren't shuffled."""
    keys = materialize(reps.select("node", "doc_id", "text_key").join(nodes.distinct(), "node", "left_semi"), "keys")
    return docs.select("doc_id", text_key(), "text").join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, ["doc_id", "text_key"]).select("node", "text")


def confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""
    texts = _texts(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": []}
        last, set_a = None, None
        for a, c, text, s in zip(b["a"], b["b"], b["text_a"], words.texts_shingle_sets(b["text_b"]), strict=True):
            if last is None or text != last:
                last, set_a = text, next(words.texts_shingle_sets([text]))
            both = len(np.intersect1d(set_a, s, assume_unique=True))
            if 100 * both >= percent * (len(set_a) + len(s) - both):
                out["a"].append(a)
                out["b"].append(c)
        return out

    return arrow_map(pairs.join(other, "b").join(one, "a"), run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest id that it reaches, for each node of edges (a, b).

    Labels travel along edges and then jump to the label of their label, so a path of n nodes takes about log n rounds.
    Every round is a written table; nothing but a count reaches the driver.
    """
    ways = materialize(edges.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*").distinct(), "edges")
    labels = materialize(ways.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        spread = ways.join(labels, ways["src"] == labels["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("m"))
        nearer = labels.join(spread, "node").select("node", "label", F.least("label", "m").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        before, after = labels, materialize(nearer.join(jump, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("label"), (F.least("near", F.coalesce("far", "near")) != F.col("label")).alias("moved")), "labels")
        discard(before)
        labels = after.select("node", "label")
        labels._clearstack_path = after._clearstack_path
        if after.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _band_keys(reps: DataFrame) -> DataFrame:
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * 4 * ROWS + 1, F.lit(4 * ROWS))))
    return reps.select("node", "text_bytes", F.posexplode(keys).alias("band", "key"))


def _mixed(members: DataFrame) -> DataFrame:
    """Keys of the groups (key, label, text_bytes) that hold several components, with their size in members of full weight.

    A member weighs one, or its share of BLOCK_BYTES where that is more than its share of BUCKET / 2 members.
    """
    weight = F.greatest(F.lit(1.0), F.col("text_bytes") * (BUCKET // 2) / BLOCK_BYTES)
    return members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum(weight).alias("size")).where("low <> high").select("key", "size")


def _cross_links(members: DataFrame, percent: int) -> DataFrame:
    """Links between components within each group of (key, half, node, label, sig, text), enough to join what they join.

    half is 0 for a group that is compared within itself; in a pair of blocks it is 1 or 2, and only pairs of 1 with 2 count.
    A pair is looked at in the first of the bands that its signatures share.
    """
    threshold = percent / 100

    def pairs(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        if len(rows) < 2:
            return
        ids, label, half, band = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        sig = _sigs([r[4] for r in rows])
        texts, sets = [r[5] for r in rows], {}
        bands = sig.reshape(len(rows), BANDS, ROWS)

        def set_of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = next(words.texts_shingle_sets([texts[k]]))
            return sets[k]

        for i in range(len(rows) - 1):
            other = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & ((half[i + 1 :] != half[i]) | (half[i] == 0)))
            other = other[plausible(np.broadcast_to(sig[i], (len(other), HASHES)), sig[other], threshold)]
            if len(other) and band[i] > 0:
                other = other[~(bands[other, : band[i]] == bands[i, : band[i]]).all(axis=2).any(axis=1)]
            if not len(other):
                continue
            own, parts = set_of(i), [set_of(j) for j in other]
            size = np.array([len(p) for p in parts])
            hashes = np.concatenate(parts)
            hit = own[np.minimum(np.searchsorted(own, hashes), len(own) - 1)] == hashes
            both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size)[:-1]]), dtype=np.int64)
            for j in other[100 * both >= percent * (len(own) + size - both)]:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    yield min(ids[i], ids[j]), max(ids[i], ids[j])

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        key, rows = None, []
        for b in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for k, *row in zip(b["key"], b["node"], b["label"], b["half"], b["band"], b["sig"], b["text"], strict=True):
                if k != key:
                    for x, y in pairs(rows):
                        out["a"].append(x)
                        out["b"].append(y)
                    key, rows = k, []
                rows.append(row)
            yield out
        found = list(pairs(rows))
        yield {"a": [x for x, _ in found], "b": [y for _, y in found]}

    columns = members.select("key", "node", "label", "half", "band", "sig", "text")
    return arrow_stream(columns.repartition("key").sortWithinPartitions("key"), run, "a long, b long").distinct()


def _blocks(named: DataFrame, groups: DataFrame) -> DataFrame:
    """The members of buckets over BUCKET as pairs of blocks of about BUCKET / 2 members or BLOCK_BYTES, which together hold every pair across components.

    The largest component of a bucket has blocks of its own. They are compared with the blocks of all others but not with
    each other, so a bucket that is nearly one component gives few rows more than it has members.
    """
    large = named.join(groups.where(F.col("size") > BUCKET), "key")
    weight = F.greatest(F.lit(1.0), F.col("text_bytes") * (BUCKET // 2) / BLOCK_BYTES)
    main = large.groupBy("key", "label").agg(F.sum(weight).alias("n"), F.first("size").alias("size"))
    main = main.groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.first("size").alias("size"))
    blocks = lambda n: F.greatest(F.ceil(n / (BUCKET // 2)), F.lit(1)).cast("long")
    main = main.select("key", F.col("m.label").alias("main"), blocks(F.col("m.n")).alias("first"), blocks(F.col("size") - F.col("m.n")).alias("more"))
    large = large.join(main, "key")
    turn, is_main = F.xxhash64("node"), F.col("label") == F.col("main")
    large = large.withColumn("own", F.when(is_main, F.pmod(turn, F.col("first"))).otherwise(F.col("first") + F.pmod(turn, F.col("more"))))
    others = F.sequence(F.when(is_main, F.col("first")).otherwise(F.lit(0).cast("long")), F.col("first") + F.col("more") - 1)
    large = large.select("key", "band", "node", "label", "own", F.explode(others).alias("other"))
    half = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return large.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "band", "node", "label", half.alias("half"))


def _rest(members: DataFrame, reps: DataFrame, docs: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links across components in all buckets that hold several, whatever their size."""
    named = members.join(labels, "node", "left").select("key", "band", "node", "text_bytes", F.coalesce("label", "node").alias("label"))
    named = materialize(named, "members")
    groups = materialize(_mixed(named), "mixed")
    texts = _texts(docs, reps, named.join(groups, "key").select("node"))
    sig = reps.select("node", "sig")
    small = named.join(groups.where(F.col("size") <= BUCKET), "key").select("key", "band", "node", "label", F.lit(0).alias("half"))
    return _cross_links(small.union(_blocks(named, groups)).join(sig, "node").join(texts, "node"), percent)


def decisions(docs: DataFrame, percent: int = 75) -> DataFrame:
    """What near_duplicates() gives, and text_key: rows that repeat both doc_id and text are one document and share a decision."""
    threshold = percent / 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialize(signatures(docs), "sets")
    reps = representatives(sets)
    bands = _band_keys(reps)
    groups = bands.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = materialize(bands.join(groups, "key").select("key", "band", "node", "text_bytes", "leader"), "buckets")
    star = members.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    first = materialize(_surviving(star, reps, threshold), "survivors")
    links = materialize(confirmed(first, docs, reps, percent).distinct(), "links")
    labels = components(links)
    more = materialize(_rest(members.drop("leader"), reps, docs, labels, percent), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    named = reps.select("set_key", "node", "doc_id", "copies").join(labels, "node", "left").where("copies > 1 or label is not null")
    # The least node of a class needn't be its least doc_id where ids repeat.
    least = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("low"))
    classes = named.join(least, "label", "left").select("set_key", F.coalesce("low", "doc_id").alias("component"))
    out = sets.select("doc_id", "text_key", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "text_key")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of docs (doc_id, text, ...).

    A null or wordless text has an empty set and is linked with nothing. A row with a null doc_id is linked with
    nothing, has a null component_id and is kept. Rows that repeat a doc_id are each linked by their own text. An empty table
    gives an empty result; columns other than doc_id and text are not read.
    """
    return decisions(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")
