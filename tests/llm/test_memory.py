"""What a Python worker holds: while it learns and hashes, and after a task, when other stages run beside it."""

import random
import re
import tracemalloc
from pathlib import Path
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from clearstack.llm import bpe, common, packing, quality

TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))


class Frame:
    """Stands for a DataFrame whose one partition runs in this process, where its memory can be read."""

    sparkSession = None

    def mapInArrow(self, run, schema):
        return run

    def select(self, *columns):
        return self


@pytest.fixture(autouse=True)
def no_session(monkeypatch):
    monkeypatch.setattr(common, "prepare", lambda spark: None)


def text(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(n))


def peak_mb(f):
    tracemalloc.start()
    try:
        out = f()
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def learn(monkeypatch, batches):
    """quality.train() of rows that are given, its one task run here: peak MB and weights."""
    task = []
    with monkeypatch.context() as m:
        for name in ("least_hashed", "held_out", "F"):
            m.setattr(quality, name, MagicMock())
        m.setattr(quality, "arrow_stream", lambda df, f, schema: task.append(f) or SimpleNamespace(first=lambda: None))
        quality.train(MagicMock(), MagicMock())
    mb, (out,) = peak_mb(lambda: list(task[0](iter(batches))))
    return mb, np.frombuffer(out["weights"][0], "<f4")


def test_training_keeps_counts_only(monkeypatch):
    rng = random.Random(1)
    batches = [{"turn": list(range(i, i + 50)), "doc_id": list(range(i, i + 50)), "quality": [k % 2 for k in range(50)], "text": [text(rng, 3000) for _ in range(50)]} for i in range(0, 400, 50)]
    features = sum(len(np.unique(f)) for b in batches for f in quality.features(b["text"]))
    mb, weights = learn(monkeypatch, batches)
    assert np.count_nonzero(weights) and features > 2_000_000
    assert mb < features * 8 / 1e6 + 25


def test_rows_alike_are_learned_in_the_order_of_their_features(monkeypatch):
    texts = ["c b a d", "a b c", "y z", "a b c d e f", "x y", "q"]
    model = quality.Ftrl()
    rows = [(t, i, q, *np.unique(f, return_counts=True), len(f)) for (t, i, q), f in zip([(5, 1, 0)] * 4 + [(3, 2, 1)] * 2, quality.features(texts), strict=True)]
    rows.sort(key=lambda r: (*r[:3], np.append(r[3], quality.DIMENSIONS).tobytes()))
    for _ in range(quality.EPOCHS):
        for _, _, q, at, n, size in rows:
            model.learn(np.append(at, quality.DIMENSIONS), np.append(quality.SCALE * n / size, 1.0), q)
    for order in ([0, 1, 2, 3, 4, 5], [5, 3, 1, 4, 2, 0]):
        b = {"turn": [[5, 3][k > 3] for k in order], "doc_id": [[1, 2][k > 3] for k in order], "quality": [[0, 1][k > 3] for k in order], "text": [texts[k] for k in order]}
        assert np.array_equal(learn(monkeypatch, [b])[1], model.weights(slice(None)).astype("<f4"))


def test_features_of_many_texts_take_little_at_once():
    rng = random.Random(2)
    texts = [text(rng, 500) for _ in range(1000)]
    assert sum(map(len, texts)) > 3_000_000
    mb, n = peak_mb(lambda: sum(len(f) for f in quality.features(texts)))
    assert n > 1_900_000 and mb < 60


def test_a_packed_partition_leaves_no_words_behind(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = packing.pack_documents(Frame(), TOKENIZER)
    rng = random.Random(3)
    rows = [text(rng, 200) for _ in range(20)]
    out = [pa.Table.from_batches(list(run(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "text": rows})])))) for _ in range(2)]
    library = bpe.encoder(TOKENIZER).library
    assert out[0].equals(out[1])
    assert dict(zip(out[0]["doc_id"].to_pylist(), out[0]["doc_tokens"].to_pylist(), strict=True)) == {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in enumerate(rows)}
    assert bpe.encoder(TOKENIZER).stored == 0 and not bpe.encoder(TOKENIZER).known.any()


def resident_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.parametrize("kind", ["arrow_map", "arrow_stream"])
def test_a_task_gives_its_free_memory_back(kind):
    """Blocks of 4 KB, all but every hundredth freed: those that stay keep the others from going back by themselves."""
    kept, full = [], []

    def f(b):
        blocks = [bytearray(b"x" * 4000) for _ in range(30_000)]
        kept.extend(blocks[::100])
        full.append(resident_mb())
        return b

    g = f if kind == "arrow_map" else lambda batches: (f(b) for b in batches)
    run = getattr(common, kind)(Frame(), g, "doc_id long")
    assert [b.to_pydict() for b in run(iter([pa.RecordBatch.from_pydict({"doc_id": [1]})]))] == [{"doc_id": [1]}]
    assert len(kept) == 300 and resident_mb() < full[0] - 80
