"""Operator 8, exact dedup by a heavy-hitter split.

Misra-Gries summaries of each partition find the digests that may hold more than 1/(k+1) of the rows. Their winners
are counted exactly, verified byte by byte and broadcast (at most ``k`` rows), so that the rows of hot groups are
settled where they are read; all other digests take an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, row_keyed, text_or_empty, trimmed

#: Counters of each Misra-Gries summary and rows of the broadcast at most.
COUNTERS = 64


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[bytes, int] = {}
        for batch in batches:
            found = pc.value_counts(batch.column("digest"))
            for key, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
                counters[key] = counters.get(key, 0) + n
            if len(counters) > k:
                cut = sorted(counters.values(), reverse=True)[k]  # takes k+1 different rows for each count it removes
                counters = {key: n - cut for key, n in counters.items() if n > cut}
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(counters), pa.binary()), "n": pa.array(list(counters.values()), pa.int64())})

    return run


def frequent_digests(rows: DataFrame, k: int = COUNTERS) -> DataFrame:
    """At most ``k`` digests, with every one that more than 1/(k+1) of the rows have among them."""
    each = rows.select("digest").mapInArrow(trimmed(_summaries(k)), "digest binary, n long")
    return each.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(k).select("digest")


def _digest(name: str = "doc.text") -> Column:
    return F.unhex(F.sha2(text_or_empty(name), 256))


def decisions(keyed: DataFrame, k: int = COUNTERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, heavy, rest): a narrow row (doc_id, file, index, digest) for each row of ``keyed``, as ``row_keyed`` gives
    it; for the heavy digests and for all others with more than one row the winner and the size of the group.

    Null text counts as empty. Of equal texts the row with the largest doc_id stays, null ids lowest; of repeated
    rows (equal id and text) exactly one stays. An empty table gives empty results.
    """
    rows = materialize(keyed.select("doc.doc_id", _digest().alias("digest"), "file", "index"))
    names = materialize(frequent_digests(rows, k))
    same = (  # byte comparison: one text only under each heavy digest
        keyed.select(_digest().alias("digest"), text_or_empty("doc.text").alias("body"))
        .join(F.broadcast(names), "digest")
        .groupBy("digest")
        .agg((F.min("body") == F.max("body")).alias("equal"))
        .filter("equal")
        .select("digest")
    )
    keep = F.max(F.struct("doc_id", "file", "index")).alias("keep")
    winners = lambda df: df.groupBy("digest").agg(keep, F.count("*").alias("n")).filter("n > 1")
    heavy = materialize(winners(rows.join(F.broadcast(names), "digest")).join(F.broadcast(same), "digest"))  # k rows at most
    rest = winners(rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti"))
    return rows, heavy, rest


def _settled(keyed: DataFrame, k: int) -> DataFrame:
    """doc_id, file, index, digest, keep and n of each row: heavy groups are settled by a broadcast of their winners, all
    others by a shuffle."""
    rows, heavy, rest = decisions(keyed, k)
    hot = rows.join(F.broadcast(heavy), "digest")
    cold = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(rest, "digest", "left")
    columns = ["doc_id", "file", "index", "digest", "keep", "n"]
    stays = F.col("keep").isNull() | ((F.col("keep.file") == F.col("file")) & (F.col("keep.index") == F.col("index")))
    return hot.select(columns).unionByName(cold.select(columns)).withColumn("kept", stays)


def exact_duplicates(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. See ``decisions`` for the rules."""
    return _settled(row_keyed(docs), k).select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: only the places of those that go are joined with the texts."""
    keyed = row_keyed(docs)
    gone = materialize(_settled(keyed, k).filter("not kept").select("file", "index"))
    return keyed.join(gone, ["file", "index"], "left_anti").select("doc.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""
