"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clearstack.llm import decontam, fingerprint, htmlblocks, langid, neardup, packing, pii, quality, rollup, warc
from clearstack.llm.common import materialize, shared_dir, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    return str(public_tokenizers.path(TOKENIZER))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(warc.write_archives(table(spark, sf_dir, "pages")), "archives")
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlblocks.extract(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    store = f"{shared_dir(spark)}/clearstack/rollup-{uuid.uuid4().hex}"
    return rollup.live_totals(table(spark, sf_dir, "documents"), store, tokenizer_path(), TOKENIZER.removesuffix(".json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_warc, op3_packing, op4_pii, op5_html_text, op6_quality, op7_token_rollup, op8_decontamination, op9_fingerprint, op10_near_dedup)
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLES = "CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) END"

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op8_decontamination": f"""
        WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
        i AS (SELECT item_id, unnest({_SHINGLES}) AS g FROM iw),
        q AS (SELECT item_id, count(*) AS q FROM i GROUP BY ALL),
        dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
        d AS (SELECT doc_id, unnest({_SHINGLES}) AS g FROM dw),
        c AS (SELECT doc_id, item_id, count(*) AS c FROM d JOIN i USING (g) GROUP BY ALL),
        h AS (SELECT doc_id, item_id, c / q AS share FROM c JOIN q USING (item_id) WHERE 100 * c >= 75 * q),
        b AS (SELECT doc_id, count(*) AS n_items, max(share) AS containment FROM h GROUP BY doc_id),
        m AS (SELECT b.*, (SELECT min(item_id) FROM h WHERE h.doc_id = b.doc_id AND h.share = b.containment) AS item_id FROM b)
        SELECT documents.doc_id, coalesce(n_items, 0) > 0 AS contaminated, coalesce(n_items, 0) AS n_items, item_id, coalesce(containment, 0.0) AS containment
        FROM documents LEFT JOIN m ON m.doc_id = documents.doc_id""",
    "op10_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT doc_id, {_SHINGLES} AS s FROM w),
        n AS (SELECT doc_id, len(s) AS n FROM s),
        e AS (SELECT doc_id, unnest(s) AS g FROM s),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
        ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS d, doc_id AS low FROM documents UNION SELECT ways.b, r.low FROM r JOIN ways ON ways.a = r.d)
        SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.low) AS component_id, min(r.low) = n.doc_id AS kept
        FROM n JOIN r ON r.d = n.doc_id GROUP BY n.doc_id, n.n""",
}
