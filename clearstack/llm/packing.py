"""Cost-balanced packing of tokenized documents into sequences.

A sequence's attention cost is estimated as LINEAR * tokens + QUADRATIC * the sum of squared piece lengths (documents
don't attend to each other). Each partition packs its own documents, in blocks of about BLOCK_TOKENS tokens: no shuffle, and a
worker holds one block. In a block

1. every full SEQUENCE of a long document is a sequence of its own; what remains of each document is one piece;
2. as many sequences are opened as the pieces fill; pieces, in descending order, go to the sequence of least cost that
   has room for them;
3. a piece that no sequence has room for is cut: it fills the sequence of least cost that has any room, and what is left goes on;
4. the one sequence that a block can't fill is cut at powers of two, which need no padding.

So padding is zero. Step 2 keeps, for each remaining capacity, the cheapest sequence, in a tree over capacities.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from clearstack.llm import bpe
from clearstack.llm.common import arrow_stream

SEQUENCE = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
BLOCK_TOKENS = 8_000_000


class _Cheapest:
    """Open sequences by remaining capacity, with the cheapest of all that have room for a piece."""

    def __init__(self, size: int) -> None:
        self.size = size + 1
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        self.tree: list[tuple[float, int, int] | None] = [None] * (2 * self.size)

    def _update(self, room: int) -> None:
        i = room + self.size
        self.tree[i] = (*self.heaps[room][0], room) if self.heaps[room] else None
        while i > 1:
            i //= 2
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = a if b is None or a is not None and a <= b else b

    def add(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._update(room)

    def take(self, least_room: int) -> tuple[float, int, int] | None:
        """Remove and return (cost, sequence, room) of the cheapest with at least so much room, the smaller number on ties."""
        best, low, high = None, least_room + self.size, 2 * self.size
        while low < high:
            for i in (low,) * (low & 1) + (high - 1,) * (high & 1):
                if self.tree[i] is not None and (best is None or self.tree[i] < best):
                    best = self.tree[i]
            low, high = (low + 1) // 2, high // 2
        if best is not None:
            heapq.heappop(self.heaps[best[2]])
            self._update(best[2])
        return best


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def pack(sizes: list[int], size: int = SEQUENCE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of documents of so many tokens, and the number of sequences."""
    pieces: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    n = 0
    for d, total in enumerate(sizes):
        for start in range(0, total - size + 1, size):
            pieces.append((d, start, size, n, 0))
            n += 1
        if total % size:
            rest.append((total % size, d, total - total % size))
    tokens = sum(x[0] for x in rest)
    full, short = divmod(tokens, size)
    room = [size] * full
    for bit in reversed(range(size.bit_length())):
        if short >> bit & 1:
            room.append(1 << bit)
    state = _Cheapest(size)
    used = [0] * len(room)
    for s, r in enumerate(room):
        state.add(r, 0.0, s)
    for length, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        while length:
            got = state.take(length) or state.take(1)
            was, s, left = got
            part = min(length, left)
            pieces.append((d, start, part, n + s, used[s]))
            used[s] += part
            if left > part:
                state.add(left - part, was + cost(part), s)
            start, length = start + part, length - part
    return pieces, n + len(room)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text), tokenized by the file and followed by end_id.

    A null or empty text is the end id alone. Repeated rows and ids are packed as documents of their own; a null doc_id stays null.
    Sequence ids are unique across partitions and the same whenever a partition is computed again. A text of any
    length is cut into full sequences. An empty table gives no rows; other columns are not read.
    """

    def answer(ids: list[int | None], tokens: list[np.ndarray], first: int) -> tuple[dict[str, list], int]:
        pieces, used = pack([len(t) for t in tokens], size)
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        for d, start, length, s, offset in pieces:
            for k, v in zip(out, (ids[d], start, length, zlib.crc32(tokens[d][start : start + length].tobytes()), len(tokens[d]), first + s, offset), strict=True):
                out[k].append(v)
        return out, used

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        encoder = bpe.encoder(tokenizer)
        first = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        held = 0
        try:
            for b in batches:
                ids += b["doc_id"]
                tokens += [np.append(t, np.uint32(end_id)).astype("<u4") for t in encoder.encode(b["text"])]
                held += sum(len(t) for t in tokens[-len(b["doc_id"]) :]) if b["doc_id"] else 0
                if held >= BLOCK_TOKENS:
                    out, used = answer(ids, tokens, first)
                    yield out
                    ids, tokens, held, first = [], [], 0, first + used
            if ids:
                yield answer(ids, tokens, first)[0]
        finally:
            encoder.forget()

    return arrow_stream(docs.select("doc_id", "text"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
