"""Each stage of the pipeline, on the rows that the stage before left, against plain Python over single rows."""

from collections import Counter

import corpus_pipeline as p
import pytest
from test_llm import DATA, TOKENIZER, components_by_force, table

from clearstack.llm import bpe, pii, quality, words


@pytest.fixture(scope="module")
def stages(spark):
    """By stage the rows that go in and those that come out."""
    docs = table(spark, "documents")
    rows, out = docs.collect(), {}
    for name, stage in p.STAGES:
        after = stage(spark, spark.createDataFrame(rows, docs.schema), DATA).collect()
        out[name] = rows, after
        rows = after
    return out


def test_quality_keeps_what_reaches_the_threshold(spark, stages):
    """The learned weights are the operator's; texts are scored one by one."""
    before, after = stages["quality"]
    weights = quality.train(table(spark, "documents"), table(spark, "labels"))
    assert sorted(after) == sorted(r for r in before if quality.scores([r.text], weights)[0] >= quality.REJECT_UNDER)


def test_near_dedup_keeps_the_smallest_id_of_each_class(stages):
    before, after = stages["near_dedup"]
    low = components_by_force([(r.doc_id, r.text) for r in before])
    assert sorted(after) == sorted(r for r in before if low[r.doc_id] == r.doc_id) and len(after) < len(before)


def test_near_dedup_keeps_texts_of_repeated_ids(spark):
    """Only the copy of A goes: B has an id that a duplicate has too, but a text of its own."""
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    docs = spark.createDataFrame([(3, a, "x", 1), (7, a, "y", 2), (7, b, "z", 3), (None, a, "n", 4), (8, None, "e", 5)], "doc_id long, text string, kept string, text_key int")
    after = p.one_of_each(spark, docs, DATA)
    assert after.columns == docs.columns and sorted(r.kept for r in after.collect()) == ["e", "n", "x", "z"]


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing column names, and an empty table go through every stage."""
    long = "word " * 30_000
    rows = [(None, "text without an id " * 10), (1, None), (1, None), (2, ""), (3, long), (4, long), (5, "mail a.b@c.org now"), (5, "mail a.b@c.org now"), (5, "quite another text of that id"), (6, " \n\t"), (7, "\x00 odd \u2028 marks \U0001f600")]
    rows = [(i, t, "en" if k % 2 else None, None, len(t) if t else None, 1, True, k) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, kept boolean, text_key long")
    for name, stage in p.STAGES:
        out = stage(spark, docs, DATA)
        assert stage(spark, docs.limit(0), DATA).count() == 0
        got = out.collect()
        if name == "packing":
            assert Counter(r.doc_id for r in got if r.start == 0) == Counter(r[0] for r in rows)
            continue
        assert out.columns == docs.columns and {r.text_key for r in got} <= set(range(len(rows)))
        if name == "near_dedup":
            assert sorted(r.text_key for r in got) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
        elif name == "pii":
            assert [r.text for r in sorted(got, key=lambda r: r.text_key)] == [t.replace("a.b@c.org", "<EMAIL>") if t else t for _, t, *_ in rows]
        elif name == "decontamination":
            assert len(got) == len(rows)


def test_decontamination_keeps_what_holds_no_item(spark, stages):
    before, after = stages["decontamination"]
    items = [words.plain_shingles(r.text) for r in table(spark, "benchmark").collect()]
    holds = lambda own: any(s and 100 * len(s & own) >= 75 * len(s) for s in items)
    assert sorted(after) == sorted(r for r in before if not holds(words.plain_shingles(r.text)))


def test_pii_redacts_each_text(stages):
    """The classifier is trained on patterns counted here; spans are those of test_pii_base_spans."""
    before, after = stages["pii"]
    counts = Counter()
    for r in before:
        base = pii.base_spans(r.text)
        every = [(k, a, e, True) for k in pii.KINDS for a, e in base[k]] + [(k, a, e, False) for k, a, e in pii.look_alikes(r.text, base)]
        counts.update(pii._pattern(r.text, *c) for c in every)
    model = pii.SpanClassifier(dict(counts))
    got = {r.doc_id: r.text for r in after}
    assert got == {r.doc_id: pii.redact_text(r.text, model) for r in before} and len(after) == len(before)
    assert any(got[r.doc_id] != r.text for r in before)


def test_packing_holds_every_token_once(stages):
    before, after = stages["packing"]
    library = bpe.encoder(TOKENIZER).library
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in before}
    got = Counter()
    for r in after:
        got[r.doc_id] += r.length
    assert got == want
