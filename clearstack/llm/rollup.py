"""Token counts as delta-maintained rollups.

Changes arrive in batches of signed rows: an insert adds a document's tokens to its (source, lang, tokenizer version),
a delete takes them away, a revision takes away the old count and adds the new one. A commit sums its batch by group,
with partial aggregation, so a hot source costs one row a task, and writes the sums to <store>/batch=<id>. Batches are
committed once: the folder is written under a temporary name and renamed, and an id that is there is left as it is, so
a retried commit changes nothing. Totals are the sum over batches; compact() replaces the batches by their sum.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearstack.llm import bpe
from clearstack.llm.common import arrow_map

GROUP = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, documents long, tokens long"


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, text_key (SHA-256 of the text) and tokens, by the tokenizer file, of each row; null texts have 0."""

    def run(b: dict[str, list]) -> dict[str, list]:
        b["tokens"] = [len(x) for x in bpe.encoder(tokenizer).encode(b.pop("text"))]
        return b

    keyed = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_key"), "text")
    return arrow_map(keyed, run, "doc_id long, source string, lang string, text_key string, tokens long")


def inserts(counts: DataFrame, version: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(1).cast("long").alias("documents"), F.col("tokens").cast("long").alias("tokens"))


def deletes(counts: DataFrame, version: str) -> DataFrame:
    return inserts(counts, version).withColumns({"documents": -F.col("documents"), "tokens": -F.col("tokens")})


def revisions(counts: DataFrame, version: str, new_tokens: str) -> DataFrame:
    """counts with the old count in tokens and the new one in new_tokens."""
    signs = F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).cast("long").alias("tokens")), F.struct(F.lit(1).cast("long").alias("documents"), F.col(new_tokens).cast("long").alias("tokens"))))
    return counts.select("source", "lang", F.lit(version).alias("tokenizer"), signs.alias("s")).select("source", "lang", "tokenizer", "s.*")


class TokenRollup:
    """Totals by source, lang and tokenizer version in a folder that all executors share.

    Null sources and languages are groups of their own. An empty batch is committed as such. Groups whose documents
    and tokens are both zero are left out of totals. Batch ids are integers >= 0; one committer at a time.
    """

    def __init__(self, spark: SparkSession, store: str) -> None:
        self.spark, self.store = spark, store.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folders(self) -> list[str]:
        fs, p = self._fs(self.store)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _batches(self) -> list[str]:
        """Folders in force: the latest sum and the batches that it doesn't hold."""
        names = self._folders()
        sums = sorted((n for n in names if n.startswith("sum=")), key=lambda n: int(n.split("=")[1]))
        held = self._held(sums[-1]) if sums else set()
        return sums[-1:] + [n for n in names if n.startswith("batch=") and int(n.split("=")[1]) not in held]

    def _held(self, name: str) -> set[int]:
        """Ids in a sum, which keeps them as runs: one row while ids are given in order."""
        runs = self.spark.read.schema("first long, last long").parquet(f"{self.store}/{name}/ids").collect()
        return {i for first, last in runs for i in range(first, last + 1)}

    def committed(self) -> set[int]:
        """Ids of all committed batches."""
        sums = [n for n in self._folders() if n.startswith("sum=")]
        out = {int(n.split("=")[1]) for n in self._folders() if n.startswith("batch=")}
        for n in sums:
            out |= self._held(n)
        return out

    def commit(self, batch: int, deltas: DataFrame) -> bool:
        """Add a batch of deltas (source, lang, tokenizer, documents, tokens); False, changing nothing, if its id is there."""
        if batch in self.committed():
            return False
        summed = deltas.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return self._put(summed, f"batch={batch}")

    def _put(self, df: DataFrame, name: str) -> bool:
        draft = f"{self.store}/_draft-{uuid.uuid4().hex}"
        df.write.parquet(f"{draft}/data")
        fs, p = self._fs(draft)
        target = self._fs(f"{self.store}/{name}")[1]
        done = not fs.exists(target) and fs.rename(p, target)
        if not done:
            fs.delete(p, True)
        return done

    def totals(self) -> DataFrame:
        paths = [f"{self.store}/{n}/data" for n in self._batches()]
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*paths)
        return rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Replace the batches in force by their sum; it takes effect by one rename, and repeating it is harmless.

        Folders that the sum before had replaced go then; those that this one replaces stay for readers until the next.
        """
        ids, used = sorted(self.committed()), set(self._batches())
        runs: list[list[int]] = []
        for i in ids:
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        names = [n for n in self._folders() if n.startswith("sum=")]
        number = max((int(n.split("=")[1]) for n in names), default=-1) + 1
        draft = f"{self.store}/_draft-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{draft}/data")
        self.spark.createDataFrame([tuple(r) for r in runs], "first long, last long").coalesce(1).write.parquet(f"{draft}/ids")
        stale = [n for n in self._folders() if n.startswith(("batch=", "sum=")) and n not in used]
        fs, p = self._fs(draft)
        fs.rename(p, self._fs(f"{self.store}/sum={number}")[1])
        for n in stale:
            fs.delete(self._fs(f"{self.store}/{n}")[1], True)


def live_totals(docs: DataFrame, store: str, tokenizer: str, version: str) -> DataFrame:
    """A corpus history as four commits, and the totals after it, by source, lang and tokenizer.

    Null texts count as empty, which is the end id alone; null sources, languages and ids are values like others (of equal
    texts one with a null id is kept only if all have none). Rows that repeat an id are documents of their own. An empty
    table gives no rows. Of equal texts whose least ids are equal too, the least source and language are kept, nulls first.

    Batch 0 inserts all documents; batch 1 revises every count by the end id that follows a document; batch 2 deletes
    exact copies, all but the smallest doc_id of equal texts; batch 1 then comes again and is left out.
    """
    from clearstack.llm.common import materialize

    counts = materialize(count_tokens(docs, tokenizer), "token-counts")
    rollup = TokenRollup(docs.sparkSession, store)
    rollup.commit(0, inserts(counts, version))
    revised = counts.withColumn("new_tokens", F.col("tokens") + 1)
    rollup.commit(1, revisions(revised, version, "new_tokens"))
    # Of each text, everything but one document goes: its whole sum by group less the first document's.
    by_text = revised.groupBy("text_key", "source", "lang", "new_tokens").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
    first = by_text.groupBy("text_key").agg(F.min_by(F.struct("source", "lang"), F.struct(F.col("low").isNull(), "low", "source", "lang")).alias("keep"), F.max("new_tokens").alias("new_tokens"))
    gone = by_text.select("source", "lang", (-F.col("n")).alias("documents"), (-F.col("n") * F.col("new_tokens")).alias("tokens"))
    back = first.select("keep.source", "keep.lang", F.lit(1).cast("long").alias("documents"), F.col("new_tokens").alias("tokens"))
    rollup.commit(2, gone.union(back).withColumn("tokenizer", F.lit(version)).select(*GROUP, "documents", "tokens"))
    if rollup.commit(1, revisions(revised, version, "new_tokens")):
        raise RuntimeError("a batch was committed twice")
    return rollup.totals()


