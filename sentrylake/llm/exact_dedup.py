"""Exact dedup (operator 9): a persistent digest index, bucketed and sorted by hash.

A new batch is reduced to one row per digest, anti-joined with the index by sort-merge, and what is new is appended as a
partition of its own. A batch may have a name: one that is repeated, as after a run that died, meets the index without its
own rows and writes its partition anew, so that it comes to the same result.
Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Within a batch the row with the
largest doc_id stays; a digest that the index already holds keeps its earlier id. A null doc_id sorts below any other.
Rows repeated with the same doc_id and text count one by one in ``group_size``; ``dedup`` keeps one of them.
An empty batch gives an empty report. Columns other than doc_id and text are never read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, make, materialize, new_path, partitions, unused

#: A hot digest is dealt over so many (digest, salt) groups before its rows meet as one row per salt.
SALTS = 64


def digest(text):
    return F.unhex(F.sha2(F.encode(ascii_lower(F.coalesce(text, F.lit(""))), "UTF-8"), 256))


class DigestIndex:
    """The index at ``path``; opened again with the same number of buckets it goes on where it ended."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or partitions(spark)
        self.table = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, batch_rows BIGINT, batch STRING) USING parquet PARTITIONED BY (batch) "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
            )
            make(spark, path)
            spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Add a batch; per row of it: doc_id, digest, keep_id, group_size (rows of this batch), is_new, kept."""
        batch = batch or uuid.uuid4().hex
        d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"))
        d = d.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        d = materialize(d, "digests")
        part = d.groupBy("digest", "salt").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
        group = part.groupBy("digest").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
        group = materialize(group.repartition(self.buckets, "digest"), "digest-groups")
        known = self.rows().filter(F.col("batch") != batch).select("digest")
        fresh = group.join(known.hint("merge"), "digest", "left_anti")
        fresh = materialize(fresh.select("digest", F.col("top").alias("keep_id"), F.col("n").alias("batch_rows")), "digest-fresh")
        # one file per bucket and batch: the same hash deals rows to tasks and to buckets
        view = f"batch_{uuid.uuid4().hex}"
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").createOrReplaceTempView(view)
        self.spark.sql("INSERT OVERWRITE TABLE {} PARTITION (batch = '{}') SELECT * FROM {}".format(self.table, batch.replace("'", ""), view))
        self.spark.catalog.dropTempView(view)
        new = fresh.select("digest", F.lit(True).alias("is_new"))
        index = self.rows().select("digest", "keep_id").hint("merge")
        resolved = group.select("digest", "n").join(index, "digest").join(new.hint("merge"), "digest", "left")
        resolved = part.select("digest", "salt").join(resolved, "digest")
        return d.join(resolved, ["digest", "salt"]).select(
            "doc_id", "digest", "keep_id", F.col("n").alias("group_size"),
            F.coalesce("is_new", F.lit(False)).alias("is_new"),
            (F.coalesce("is_new", F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        )


def report(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (hex of the normalised text)."""
    index = index or DigestIndex(docs.sparkSession, new_path(docs.sparkSession, "digest-index"))
    return index.append(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, all their columns."""
    index = index or DigestIndex(docs.sparkSession, new_path(docs.sparkSession, "digest-index"))
    id_, own, other = (unused(docs, x) for x in ("kept_id", "own_digest", "kept_digest"))
    kept = index.append(docs).filter("kept").select(F.col("doc_id").alias(id_), F.col("digest").alias(other))
    repeated = not kept.groupBy(id_, other).count().filter("count > 1").isEmpty()
    kept = kept.dropDuplicates() if repeated else kept
    out = docs.withColumn(own, digest(F.col("text")))
    out = out.join(kept, out["doc_id"].eqNullSafe(kept[id_]) & (out[own] == kept[other]), "left_semi")
    if repeated:
        out = out.dropDuplicates(["doc_id", own])
    return out.drop(own)
