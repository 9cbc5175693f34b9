"""Each operator against a brute-force version, an exact round trip or held-out rows, and on odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from clearstack.llm import bpe, decontam, fingerprint, htmlblocks, langid, neardup, packing, pii, quality, rollup, warc, words
from clearstack.llm.common import held_out

DATA = "/root/testdata/sf0.001"
TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = [None, "", "   \n", "one two three", "a " * 5000, "Ünï çödé 日本 text İx <|endoftext|>", "x" * 20000, "same text here and there again", "same text here and there again"]


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, "s", 0, 1) for i, t in enumerate(ODD)] + [(None, "text without an id", "en", None, 3, 1), (7, ODD[7], "en", "s", 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, tokens int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_word_and_shingle_hashes():
    texts = [t or "" for t in ODD] + ["A b\tC d\ne f g a B c d e"]
    assert [len(s) for s in words.texts_shingle_sets(texts)] == [len(words.plain_shingles(t)) for t in texts]


def test_bpe_equals_library():
    e = bpe.encoder(TOKENIZER)
    texts = [t or "" for t in ODD] + ["it's we're I'll 'tis ''s '' 12ab3 é9è", "a\x1cb \x85 c", "'" * 70 + "s"]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]


def components_by_force(rows):
    sets = {i: words.plain_shingles(t) for i, t in rows}
    low = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_near_duplicates(spark, odd, none):
    docs = table(spark, "documents")
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {i: r.component_id for i, r in got.items()} == components_by_force(rows)
    assert all(got[i].n_shingles == len(words.plain_shingles(t)) for i, t in rows)
    out = neardup.near_duplicates(odd).collect()
    assert len(out) == len(ODD) + 2 and {r.component_id for r in out if r.doc_id in (7, 8)} == {7}
    assert [r.kept for r in out if r.doc_id is None] == [True]
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_chain(spark, monkeypatch):
    """A chain of texts, each near its neighbours only, with buckets so small that every way of splitting them is taken."""
    base = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(base[k * 12 : k * 12 + 120])) for k in range(20)] + [(100 + k, " ".join(base[300:390] + [f"z{k}"])) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = components_by_force(rows)
    for bucket in (2000, 4):
        monkeypatch.setattr(neardup, "BUCKET", bucket)
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == expected


def test_near_duplicates_that_share_only_the_band_of_a_large_bucket(spark, monkeypatch):
    """Buckets over BUCKET hold pairs whose signatures share no other band, within and across the largest component."""
    monkeypatch.setattr(neardup, "BUCKET", 4)
    rng = np.random.default_rng(2)
    sigs = rng.integers(0, 1 << 32, (14, neardup.HASHES), dtype=np.uint32)
    sigs[:, : neardup.ROWS] = 7
    for a, b in ((0, 1), (2, 9)):
        sigs[b] = sigs[a]
        sigs[b, neardup.ROWS :: neardup.ROWS] += np.uint32(1)  # one value of each other band
    texts = [" ".join(f"d{i}w{k}" for k in range(60)) for i in range(14)]
    texts[1], texts[9] = texts[0] + " more", texts[2] + " more"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reps = spark.createDataFrame([(i, s.astype("<u4").tobytes(), 0) for i, s in enumerate(sigs)], "doc_id long, sig binary, text_bytes long")
    reps = reps.join(docs.select("doc_id", neardup.text_key()), "doc_id").withColumn("node", F.col("doc_id"))
    members = neardup._band_keys(reps).where("band = 0")
    labels = spark.createDataFrame([(i, 5) for i in range(5, 12)], "node long, label long")
    got = {tuple(r) for r in neardup._rest(members, reps, docs, labels, 75).collect()}
    assert got == {(0, 1), (2, 9)}


def test_near_duplicates_of_rows_that_repeat_ids(spark):
    """Each row is linked by its own text, and a node stands for one set, whatever ids repeat."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    near_c = c + " more"
    rows = [(3, a), (7, a), (7, b), (7, c), (9, near_c), (3, a), (7, near_c), (None, a), (7, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(3, 3, True), (7, 3, False), (7, 7, True), (7, 7, True), (9, 7, False), (3, 3, True), (7, 7, True), (None, None, True), (7, 7, True)]
    assert got == sorted(want, key=str)


def test_near_duplicates_in_blocks_bounded_by_bytes(spark, monkeypatch):
    """Blocks by bytes of text give the classes that blocks by members give."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 2000)
    base = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(base[k * 12 : k * 12 + 120])) for k in range(20)] + [(100 + k, " ".join(base[300:390] + [f"z{k}"])) for k in range(12)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == components_by_force(rows)


def test_bayes_bounds():
    least = neardup.least_matches(0.75)
    assert list(least) == sorted(least) and 60 < least[-1] < 96


def test_decontamination(spark, odd, none):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    sets = {r.item_id: words.plain_shingles(r.text) for r in items.collect()}
    got = {r.doc_id: r for r in decontam.decontaminate(docs, items).collect()}
    for r in docs.collect():
        own = words.plain_shingles(r.text)
        shares = {i: len(s & own) / len(s) for i, s in sets.items() if 100 * len(s & own) >= 75 * len(s)}
        assert got[r.doc_id].n_items == len(shares) and got[r.doc_id].item_id == (min(shares, key=lambda i: (-shares[i], i)) if shares else None)
    few = spark.createDataFrame([(1, "two three"), (2, None), (3, "one three"), (None, "x")], "item_id long, text string")
    assert {r.doc_id: r.item_id for r in decontam.decontaminate(odd, few).collect()}[3] == 1
    assert decontam.decontaminate(none, few).count() == 0 and decontam.decontaminate(odd, few.limit(0)).where("contaminated").count() == 0


def test_decontamination_by_joins(spark, odd, monkeypatch):
    """Items beyond the broadcast bound give the same answers by joins, on odd rows and repeated ids too."""
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    few = spark.createDataFrame([(1, "two three"), (2, None), (3, "one three"), (None, "x"), (4, "same text here and there again"), (4, "one two three")], "item_id long, text string")
    cases = [(docs, items), (odd, few), (odd.limit(0), few), (odd, few.limit(0))]
    rows = lambda d, i: sorted(map(str, decontam.decontaminate(d, i).collect()))
    kept = lambda d, i: sorted(map(str, decontam.uncontaminated(d, i).collect()))
    want = [(rows(*c), kept(*c)) for c in cases]
    monkeypatch.setattr(decontam, "BLOCK_BYTES", -1)
    assert [(rows(*c), kept(*c)) for c in cases] == want
    assert any("contaminated=True" in r for r in want[0][0]) and any("contaminated=True" in r for r in want[1][0])


def test_fingerprints(spark, odd, none):
    docs = table(spark, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    bag = lambda t: Counter(w for w in words.plain_words(t) if w)
    errors = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[i].n_chars == len(t)
        a, b = bag(t), bag(e)
        errors.append(got[i].near_edited - sum((a & b).values()) / max(1, sum((a | b).values())))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    out = fingerprint.fingerprints(odd).collect()
    assert len(out) == len(ODD) + 2 and len({r.fingerprint for r in out if r.doc_id in (7, 8)}) == 1
    assert fingerprint.fingerprints(none).count() == 0
    assert fingerprint.fingerprints(odd.where("doc_id = 3")).first().near_next == 1.0


def test_fingerprints_of_neighbours_across_ranges(spark, monkeypatch):
    """Every likeness is that of two samples, with few rows a range, repeated ids, null ids and a group of equal rows."""
    monkeypatch.setattr(fingerprint, "PARTITION_ROWS", 7)
    texts = [f"w{k % 5} w{k % 7} common words here w{k}" for k in range(60)]
    rows = [(k * 3 % 61, t) for k, t in enumerate(texts)] + [(5, f"again {k}") for k in range(20)] + [(None, f"no id {k % 3}") for k in range(12)] + [(9, "equal rows")] * 15 + [(70, None)]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    own = {t: fingerprint.signatures([t])[0] for t in {t or "" for _, t in rows}}
    turn = {r.t: r.h for r in spark.createDataFrame([(t,) for t in own], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, turn[r[1] or ""]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        changed = fingerprint.signatures([e])[0]
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.likeness(own[t], changed), fingerprint.likeness(own[t], own[following]))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == want


def naive_signature(bag):
    """Consistent weighted sampling, a term and a sample at a time."""
    out = []
    for s in range(fingerprint.SAMPLES):
        least = None
        for term, weight in bag.items():
            r, b, lnc = (np.float32(x) for x in fingerprint._draws(np.array([term], np.uint64))[0, :, s])
            t = np.floor(np.log(np.float64(weight)).astype(np.float32) / r + b)
            value = lnc - r * (t - b + 1)
            least = value if least is None or value < least else least
        out.append(least)
    return np.array(out)


def test_fingerprints_by_force():
    """Samples agree with naive ones, so likenesses do."""
    bags = [Counter(t.split()) for t in ("a a a b c d", "a b b c e", "x y z", "a a a b c d")]
    naive, fast = [], []
    for bag in bags:
        terms = {int(next(words.texts_word_hashes([w]))[0]): n for w, n in bag.items()}
        order = np.array(sorted(terms), np.uint64)
        naive.append(naive_signature(terms))
        fast.append(fingerprint.weights_signature(order, np.array([terms[int(h)] for h in order])))
    for i in range(4):
        for j in range(4):
            assert fingerprint.likeness(fast[i], fast[j]) == (naive[i] == naive[j]).mean()
    assert fingerprint.likeness(fast[0], fast[3]) == 1.0 and 0 < fingerprint.likeness(fast[0], fast[1]) < 1


def test_fingerprints_of_long_texts_without_a_common_word():
    """40,000 distinct words each; a table of draws smaller than that gives the same samples as none before."""
    texts = [" ".join(f"{c}{k}" for k in range(40_000)) + f" {c}0" * 3 for c in "ab"]
    one, other = fingerprint.signatures(texts)
    assert fingerprint.likeness(one, other) < 0.03
    fingerprint._tables.cache_clear()
    assert (fingerprint.signatures(texts[1:])[0] == other).all()


def test_packing(spark, odd, none):
    docs = table(spark, "documents").select("doc_id", "text").union(odd.where("doc_id < 7").select(F.col("doc_id") + 10**6, "text"))
    rows = packing.pack_documents(docs, TOKENIZER).toPandas()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.values == np.concatenate([[0], g.length.cumsum().values[:-1]])).all()
        n = g.length.sum()
        assert n == 4096 or n & (n - 1) == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    e = bpe.encoder(TOKENIZER)
    import zlib

    for i, g in rows.sort_values("start").groupby("doc_id"):
        ids = np.append(e.encode([texts[i]])[0], np.uint32(2)).astype("<u4")
        assert g.length.sum() == len(ids) == g.doc_tokens.iloc[0] and (g.start.values == np.concatenate([[0], g.length.cumsum().values[:-1]])).all()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(g.start, g.length, g.ids_crc32))
    assert set(rows.doc_id) == set(texts) and packing.pack_documents(none, TOKENIZER).count() == 0


def test_rollup(spark, tmp_path, odd):
    docs = table(spark, "documents").select("doc_id", "text", "lang", "source").union(odd.select("doc_id", "text", "lang", "source"))
    total = rollup.live_totals(docs, f"{tmp_path}/r", TOKENIZER, "v").toPandas()
    seen, expected, by = set(), Counter(), {}
    e = bpe.encoder(TOKENIZER)
    name = lambda v: (v is not None, v or "")
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id, name(r.source), name(r.lang))):
        if (r.text or "") not in seen:
            seen.add(r.text or "")
            expected["documents"] += 1
            expected["tokens"] += len(e.encode([r.text])[0]) + 1
            own = by.setdefault((r.source, r.lang), [0, 0])
            own[0], own[1] = own[0] + 1, own[1] + len(e.encode([r.text])[0]) + 1
    assert total.documents.sum() == expected["documents"] and total.tokens.sum() == expected["tokens"]
    groups = lambda d: {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in d.collect()}
    assert groups(rollup.TokenRollup(spark, f"{tmp_path}/r").totals()) == {(*k, "v"): tuple(v) for k, v in by.items()}
    r = rollup.TokenRollup(spark, f"{tmp_path}/r")
    r.compact()
    assert not r.commit(2, spark.createDataFrame([], rollup.DELTA)) and sorted(map(str, r.totals().collect())) == sorted(map(str, rollup.TokenRollup(spark, f"{tmp_path}/r").totals().collect()))
    assert r.totals().agg(F.sum("tokens")).first()[0] == expected["tokens"]
    assert r.commit(7, rollup.inserts(spark.createDataFrame([("s", "l", 5)], "source string, lang string, tokens long"), "v"))
    r.compact()
    assert not any(n.startswith("batch=") and n != "batch=7" for n in r._folders()) and r.committed() == {0, 1, 2, 7}
    assert r.totals().agg(F.sum("tokens")).first()[0] == expected["tokens"] + 5 and not r.commit(0, spark.createDataFrame([], rollup.DELTA))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_holds(kind, s):
    d = re.sub("[^0-9]", "", s)
    luhn = lambda: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def test_pii_base_spans():

    texts = ["a@b.c@d.e x@y @z.com a@@b.com a@b..c a@b.c..d", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 01.002.3.255", "4111 1111-1111 1111 4111111111111111222 4111111111111111", "+1 (555) 123-4567--89 +12 +1234567890123456 ++1 222 333 4444", "", "9" * 3000]
    for t in texts:
        assert pii.base_spans(t) == {k: [m.span() for m in re.finditer(p, t) if base_holds(k, m[0])] for k, p in BASE.items()}


def test_pii_spelled_out_email_in_capitals():
    for text in ("JANE [AT] EXAMPLE [DOT] COM", "Jane (At) Example (Dot) Com", "jane {aT} example.com"):
        assert pii.look_alikes(text, pii.base_spans(text)) == [("email", 0, len(text))]


PLANTED = {
    "accepted": ["write to jo (at) site (dot) com today", "mail: jo [at] site.org", "contact jo at site dot com", "server 2001:db8::8a2e:370:7334 up", "card 4111.1111.1111.1111 ok", "4111 / 1111 / 1111 / 1111 x", "call (555) 123-4567 now", "tel: 0044 20 7946 0958"],
    "rejected": ["4111 1111 1111 1112 in a list", "9807915762804490 raie", "host 999.1.2.300 not", "2024-01-15 12 30 01", "years 1998 1999 2000 2001 and", "look at this dot matrix", "ratio ab::cd here", "order 555-123-4567 shipped", "isbn 978 0306 40615 7", "sum 123 456 789 000"],
}


def test_pii_votes_accept_and_reject(spark):
    """What the look-alikes become, trained on themselves and on base spans; context, checks and calendar decide."""
    base = ["mail a.b@c.com", "ip 10.1.2.3", "card 4111111111111111", "+1 (456) 555-2186"] * 30
    texts = base + PLANTED["accepted"] + PLANTED["rejected"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_spans(docs).collect()}
    for i, t in enumerate(texts):
        want = 1 if t in base or t in PLANTED["accepted"] else 0
        assert len([x for x in got[i].split(",") if x]) == want, (t, got[i])
    found = pii.candidates(docs)
    out = pii.outcomes(found, pii.train(found))
    assert sum(n for (_, k), n in out.items() if k == "accepted") == len(PLANTED["accepted"])
    assert sum(n for (_, k), n in out.items() if k == "rejected") >= 7 and out[("card", "rejected")] >= 2


def test_pii_label_model_by_force():
    """EM over single candidates, one vote at a time, gives what EM over counted patterns gives."""
    counts = {"card|110000|0": 40, "card|220000|0": 9, "card|222000|1": 5, "card|011100|0": 3, "card|002020|2": 4, "phone|001100|4": 2}
    rows = [pii._parsed(p)[1] for p, n in counts.items() if p.startswith("card") for _ in range(n)]
    share, yes = [0.25, 0.75], [[0.1, 0.9] for _ in pii.LABELERS]

    def posterior(v):
        odds = share[v[0] == 1] / (1 - share[v[0] == 1])
        for j, c in enumerate(v):
            if c:
                odds *= yes[j][1] / yes[j][0] if c == 1 else (1 - yes[j][1]) / (1 - yes[j][0])
        return odds / (1 + odds)

    for _ in range(pii._ROUNDS):
        q = [posterior(v) for v in rows]
        for g in (0, 1):
            own = [p for p, v in zip(q, rows) if (v[0] == 1) == bool(g)]
            share[g] = (sum(own) + pii.LOOSE[g]) / (len(own) + 4)
        for j in range(len(pii.LABELERS)):
            for truth in (0, 1):
                weight = [p if truth else 1 - p for p in q]
                voted = sum(w for w, v in zip(weight, rows) if v[j])
                said = sum(w for w, v in zip(weight, rows) if v[j] == 1)
                yes[j][truth] = (said + pii.PRIOR[1 - truth]) / (voted + 10)
    model = pii.LabelModel(counts)
    assert np.allclose(model.yes["card"], yes) and np.allclose(model.share["card"], share)
    assert np.allclose([model.posteriors("card", np.array([v]))[0] for v in rows], [posterior(v) for v in rows])
    assert model.posteriors("card", np.array([[0, 1, 1, 0, 0, 0]]))[0] > 0.9 > model.posteriors("card", np.array([[2, 2, 1, 0, 0, 0]]))[0]


def test_pii_columns_by_force(spark):
    """Counts and base_sha256 of the whole table, from the contract's patterns with re."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    for i, t in docs.select("doc_id", "text").collect():
        spans = {k: [m.span() for m in re.finditer(p, t or "") if base_holds(k, m[0])] for k, p in BASE.items()}
        digest = hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, own in spans.items() for a, e in own).encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone, got[i].base_sha256) == (*map(len, spans.values()), digest)


def test_pii_query(spark, odd, none):
    extra = spark.createDataFrame([(1, "mail me: jo (at) site (dot) com or +1 (456) 555-2186, 10.1.2.3"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find_spans(table(spark, "documents").select((F.col("doc_id") + 100).alias("doc_id"), "text").union(extra)).collect()}
    assert (out[1].n_phone, out[1].n_ip, out[1].n_email, out[2].spans) == (1, 1, 0, "")
    assert "phone:" in out[1].spans and out[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_spans(odd).count() == len(ODD) + 2 and pii.find_spans(none).count() == 0
    model = pii.train_on(extra)
    assert pii.redact_text("a b@c.de f", model) == "a <EMAIL> f" and pii.redact_text(None, model) is None


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert rows.where("lang = lang_pred").count() >= 0.97 * rows.count()
    out = {r.doc_id: r.lang_pred for r in langid.identify(odd).collect() if r.doc_id is not None}
    assert out[0] == out[1] == out[2] == "und" and langid.identify(none).count() == 0


def naive_profile(text):
    """Each trigram's vector is bound from its letters' vectors and added, one after another."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    letters = " " + " ".join(letters.split()) + " "
    slot = lambda c: 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) * 40503 % 65536 % 101
    total = np.zeros(langid.DIMENSIONS)
    for k in range(len(letters) - 2):
        x, y, z = (langid._LETTERS[slot(c)].astype(int) for c in letters[k : k + 3])
        total += np.roll(x, 2) * np.roll(y, 1) * z
    return total


def test_language_by_force(spark, monkeypatch):
    """Predictions and scores equal those of naive profiles; ties go to the first language by name."""
    texts = ["the cat sat on the mat", "le chat est sur le tapis là", "der Hund läuft über die Straße", "日本 語の文 章です", "el perro corre", "tie tie", "Ünï 日 çödé"]
    rows = [(i, t, ["en", "fr", "de", "ja", "es"][i % 5] if i != 5 else "zz") for i, t in enumerate(texts * 3)] + [(100, "the cat sat on the mat", "aa"), (101, None, "en"), (102, "12 34", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    import zlib

    learned = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5 and t and any(c.isalpha() for c in t)]
    profiles = {lang: sum(naive_profile(t) for t, o in learned if o == lang) for lang in sorted({lang for _, lang in learned})}
    for cells in (1 << 23, 40):
        monkeypatch.setattr(langid, "_CELLS", cells)
        for r in langid.identify(docs).collect():
            text = {i: t for i, t, _ in rows}[r.doc_id]
            if not text or not any(c.isalpha() for c in text):
                assert (r.lang_pred, r.score) == ("und", 0.0)
                continue
            own = naive_profile(text)
            near = {k: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for k, v in profiles.items()}
            best = max(near.values())
            assert abs(r.score - max(best, 0)) < 1e-6 and r.lang_pred in [k for k in near if near[k] > best - 1e-9]
    same = spark.createDataFrame([(i, "one text here", "b" if i % 2 else "a") for i in range(1, 40)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(same).collect()} == {"a"}


def test_language_memory_of_many_letters():
    """512 texts of 4,000 letters out of 20,000 are bundled in bounded memory."""
    import resource

    rng = np.random.default_rng(3)
    codes = [langid.trigrams("".join(map(chr, rng.integers(0x4E00, 0x9C00, 4000)))) for _ in range(512)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = langid.bundles(list(range(512)), codes, 512)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert (langid.bundles([0], codes[-1:], 1)[0] == out[-1]).all()


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out")
    assert rows.where("predicted = quality").count() >= 0.9 * rows.count()
    assert quality.classify(odd, labels).count() == len(ODD) + 2 and quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert docs.where(held_out()).count() > 0


def test_warc_round_trip(spark):
    long = "<p>" + "é word " * 100
    rows = [(3, "http://a b/\n", long), (1, None, long), (2, "http://x", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", long), (7, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(pages)
    got = warc.read_archives(archives, payloads=True).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert [(by[i].record_type, by[i].refers_to) for i in (1, 2, 3, 4, 5)] == [("response", None), ("revisit", 1), ("revisit", 1), ("response", None), ("response", None)]
    for i, _, h in rows:
        body = (h or "").encode()
        assert by[i].payload_bytes == len(body) and by[i].payload_digest == hashlib.sha256(body).hexdigest()
        assert by[i].record_type == "revisit" or by[i].payload == body
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_joins_many_groups(spark, monkeypatch):
    """Groups of equal payloads joined by shuffle, one of many copies, give what a broadcast gives; record ids are unique."""
    rows = [(i, f"u{i}", "<p>" + ("same " * 40 if i % 3 else f"own {i} " * 40)) for i in range(120)] + [(5, "v", "<p>" + "another page 5 " * 20), (None, "n", "<p>" + "same " * 40), (None, "n", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = lambda: sorted(map(str, warc.read_archives(warc.write_archives(pages)).select("page_id", "url", "payload_digest", "record_type", "refers_to").collect()))
    want = read()
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    assert read() == want and sum("refers_to=1" in r for r in want) == 79
    monkeypatch.setattr(warc, "READ_ROWS", 7)
    got = warc.read_archives(warc.write_archives(pages), payloads=True).collect()
    assert len({r.record_id for r in got}) == len(rows) and sorted(r.payload for r in got if r.record_type == "response")[0] == b"<p>another page 5 " + b"another page 5 " * 19


def test_packing_by_force():
    """Descending pieces, each to the cheapest sequence with room, as a plain loop over all sequences gives them."""
    rng = np.random.default_rng(9)
    for size, sizes in ((16, rng.integers(0, 40, 60)), (64, rng.integers(1, 64, 80)), (16, [16, 16, 0, 5]), (16, []), (16, [3] * 33)):
        want, rest, n = [], [], 0
        for d, total in enumerate(sizes):
            for start in range(0, total - size + 1, size):
                want.append((d, start, size, n, 0))
                n += 1
            if total % size:
                rest.append((total % size, d, total - total % size))
        full, short = divmod(sum(r[0] for r in rest), size)
        room = [size] * full + [1 << b for b in reversed(range(10)) if short >> b & 1]
        costs, used = [0.0] * len(room), [0] * len(room)
        for length, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
            while length:
                fits = [s for s in range(len(room)) if room[s] - used[s] >= length] or [s for s in range(len(room)) if room[s] > used[s]]
                s = min(fits, key=lambda s: (costs[s], s))
                part = min(length, room[s] - used[s])
                want.append((d, start, part, n + s, used[s]))
                used[s], costs[s] = used[s] + part, costs[s] + part + part * part / 1024
                start, length = start + part, length - part
        got, count = packing.pack([int(x) for x in sizes], size)
        assert got == [tuple(map(int, w)) for w in want] and count == n + len(room)


def test_quality_by_force(spark):
    """Weights and scores equal those of a plain FTRL, a feature at a time, over the rows in the order of their hashes."""
    import math
    import zlib

    rows = [(i, f"good text number {i} here, fine." if i % 3 else f"BAD!!! spam {i} $$$ bad", int(i % 3 > 0)) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(50, None), (51, ""), (3, rows[3][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(50, 1), (None, 1), (2, None)], "doc_id long, quality int")
    turn = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    learned = sorted(((turn[i], i, q, t) for i, t, q in [*rows, rows[3]] if zlib.crc32(str(i).encode()) % 5), key=lambda r: r[:3])
    z, n = Counter(), Counter()

    def weight(k):
        return 0.0 if abs(z[k]) <= quality.L1 else -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    def values(text):
        index = next(quality.features([text])).tolist()
        return {**{k: quality.SCALE * c / len(index) for k, c in Counter(index).items()}, quality.DIMENSIONS: 1.0}

    for _ in range(quality.EPOCHS):
        for _, _, q, t in learned:
            x = values(t)
            now = {k: weight(k) for k in x}
            error = 1 / (1 + math.exp(-sum(now[k] * v for k, v in x.items()))) - q
            for k, v in x.items():
                g = error * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * now[k]
                n[k] += g * g
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    for i, t, _ in rows:
        score = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in values(t).items())))
        assert abs(got[i] - score) < 1e-5
    assert abs(got[50] - 1 / (1 + math.exp(-weight(quality.DIMENSIONS)))) < 1e-5 and got[50] == got[51]
    tokens = "Ab, ab!! 12"  # five tokens: Ab , ab !! 12
    assert len(next(quality.features([tokens]))) == 5 + 4 + 4 + 3 and set(next(quality.features(["Ab"]))) != set(next(quality.features(["ab"])))


def test_quality_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    """A labelled id on many rows gives no more than the bound to the task that learns."""
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    stream = quality.arrow_stream
    monkeypatch.setattr(quality, "arrow_stream", lambda df, *a: seen.append(df.count()) or stream(df, *a))
    quality.train(docs, labels, 20)
    assert 0 < seen[0] <= 20


def test_warc_checks():
    samples = [(f"<html>{i} " + "some common words here and there " * 20).encode() for i in range(200)]
    w = warc.ArchiveWriter(warc.train_dictionary(samples))
    for i, s in enumerate(samples[:5]):
        w.add(warc.page_record(i, "u", s, hashlib.sha256(s).hexdigest(), None, False))
    data = w.take()
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and [r.payload for r in warc.read_archive(data)] == samples[:5]
    for broken in (data[:-3], data + b"xx", data.replace(data[-6:], b"\0" * 6)):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(broken))
    for bad in (b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n", warc.record_bytes([("WARC-Type", "x"), ("WARC-Record-ID", "y"), ("WARC-Date", "z")], b"abc")[:-1]):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def test_lstm_gradient():
    rng = np.random.RandomState(1)
    m = htmlblocks.BiLstm()
    m.weights = [w.astype(np.float64) for w in m.weights]
    x, mask, y = rng.randn(2, 4, htmlblocks.INPUT), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float), rng.randint(0, 2, (2, 4))
    loss = lambda: -(mask * (y * np.log(m.predict(x, mask)) + (1 - y) * np.log(1 - m.predict(x, mask)))).sum() / mask.sum()
    for w, g in zip(m.weights, m.gradient(x, mask, y)):
        at = tuple(rng.randint(n) for n in w.shape)
        w[at] += 1e-4
        up = loss()
        w[at] -= 2e-4
        down = loss()
        w[at] += 1e-4
        assert abs((up - down) / 2e-4 - g[at]) < 1e-4


def test_html(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    import html

    def gold(h):
        a = re.search(r"<article>(.*?)(</article>|$)", h, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|article)>", a)]
        return "\n".join(p for p in parts if p)

    got = {r.page_id: r.text for r in htmlblocks.extract(pages).collect()}
    rows = pages.collect()
    assert sum(got[r.page_id] == gold(r.html) for r in rows) >= 0.98 * len(rows)
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>a <b"), (4, "u", "no tags &am < 3")], "page_id long, url string, html string")
    assert htmlblocks.extract(odd, htmlblocks.BiLstm()).count() == 4
    assert [b[0] for b in htmlblocks.blocks("<p>a&amp;b\n c<script>x</p></script><p>d<br>e<div>f")] == ["a&b c", "d e", "f"]


def test_html_takes_time_in_proportion():
    """Pages of a megabyte that nest, cut off or quote tags in odd ways; each took minutes or more by rescanning."""
    import time

    pages = ["<a " * 350_000, '<a ">"' * 150_000, "<a '\">" * 150_000, "<div>x" * 10_000, "<div>" * 10_000 + "x</b>" * 100_000, "<" * 500_000, "<p>a<b>" * 20_000, "<i class=\"a" * 80_000]
    began = time.time()
    cut = [htmlblocks.blocks(p) for p in pages]
    htmlblocks.label(cut, htmlblocks.BiLstm())
    assert time.time() - began < 60
    assert [len(b) for b in cut][3] == 10_000 and cut[3][-1][1].depth == 10_000 and cut[3][4][1].elements() == ("div",) * 5


def test_html_keeps_what_is_shown():
    page = "<p>where <math><mi>x</mi></math> is <noscript>shown</noscript> big, <object>an o</object> <img src=x> and <svg><title>no</title><text>t</text></svg>.</p><xmp><b>&amp;</xmp><p>a <custom-tag>b</custom-tag> <a href='x>y'>c</a> 1 < 2 <a href=\"x>d</a> e <select><option>no</select><!-- no --><textarea>no</textarea>f</p><p>g <b"
    assert [b[0] for b in htmlblocks.blocks(page)] == ["where x is shown big, an o and t.", "<b>&amp;", "a b c 1 < 2 d e f", "g"]


def test_html_odd_tables(spark):
    """Empty tables, repeated rows, null ids and columns named as the result's."""
    rows = [(1, "u", "<article><p>one two three</article>", "x", 5), (1, "u", "<article><p>one two three</article>", "x", 5), (None, None, "<p>" + "word " * 30, "y", None), (3, "u", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = htmlblocks.extract(pages).collect()
    assert len(out) == 4 and [r.text for r in out if r.page_id == 3] == [""] and len({r.text for r in out if r.page_id == 1}) == 1
    assert htmlblocks.extract(pages.limit(0)).count() == 0


def test_html_raw_elements_end_at_their_own_tags_at_every_size():
    for n in (1, 12, 300, 1 << 16):
        got = [b[0] for b in htmlblocks.blocks("<p>" + "İ" * n + "</p><SCRIPT>x</ſcript><p>y</Script>kept text here<p>more</p>")]
        assert got == ["İ" * n, "kept text here", "more"]


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = table(spark, "documents")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, kept, DATA)
        assert after.columns == docs.columns
        rows = after.collect()
        kept = spark.createDataFrame(rows, docs.schema)
    assert 0 < len(rows) < docs.count()
    assert p.STAGES[-1][1](spark, kept, DATA).select("doc_id").distinct().count() == len(rows)
