"""Token-ID output (operator 6): a content-addressed store.

Each document's ids (text encoded, then an end id) are cut into chunks by a rolling hash over the last 16 ids; every
unique chunk is stored once under its digest; a document's recipe lists its chunks; recipes lie in shards in ascending
doc_id order (nulls first, repeated doc_ids by recipe); a manifest holds each shard's first token, counts and Merkle
root, and a root over the shards. Reading back recomputes every chunk's digest and every shard's root.

A null text counts as empty, whose ids are the end id alone. Repeated rows are written one by one. Empty input gives an
empty store. Only doc_id and text are read, so further columns cannot clash.

Folder layout (Parquet): ``data/kind=0`` chunks (digest, n, ids as little-endian unsigned integers of 2 bytes where the
vocabulary allows, else 4), ``recipes`` (shard, row, doc_id, n_tokens, recipe of 20 bytes a chunk), ``manifest``.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, partitions
from .encoding import default_path, encoder, text_slices

#: Chunk sizes in ids: none under LEAST but at a document's end, a cut at one position in AVERAGE, none over MOST.
LEAST, AVERAGE, MOST = 64, 512, 4096
WINDOW = 16
_GEAR = np.random.default_rng(20240611).integers(0, 2**63, 65536, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
DIGEST_BYTES = 16
#: Documents of a shard, about, at most.
SHARD_DOCS = 200_000


def marks(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW ids asks for a cut."""
    g = _GEAR[ids & 0xFFFF] ^ (ids >> 16).astype(np.uint64)
    h = g.copy()
    for k in range(1, min(WINDOW, len(ids))):
        h[k:] += g[:-k] << np.uint64(3 * k)
    return np.flatnonzero((h >> np.uint64(48)) & np.uint64(AVERAGE - 1) == 0) + 1


def cut_points(n: int, at_marks: list[int]) -> list[int]:
    """Ends of the chunks of a document of n ids."""
    ends, at = [], 0
    for m in [*at_marks, n]:
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m - at >= LEAST or m == n and m > at:
            ends.append(m)
            at = m
    return ends


def digest(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=DIGEST_BYTES).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256 over the leaves, in order; an odd one goes up unchanged."""
    level = list(leaves) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        nxt = [hashlib.sha256(level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = nxt + level[len(level) - len(level) % 2 :]
    return level[0]


def _leaf(doc_id, recipe: bytes) -> bytes:
    return hashlib.sha256(repr(doc_id).encode() + b"\0" + recipe).digest()


def _chunks(path: str, end_id: int, wide: bool):
    dtype = "<u4" if wide else "<u2"
    schema = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])

    def run(batches):
        enc, seen, end = encoder(path), set(), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for at, texts in text_slices(batch.column(1), 2 << 20):
                rows = []
                raws = [raw + end for raw in enc.encode(texts)]
                every = np.frombuffer(b"".join(raws), "<u4")
                body, size = every.astype(dtype).tobytes(), np.dtype(dtype).itemsize
                # a window that reaches into the document before ends under LEAST ids, where nothing is cut
                cuts, lasts = marks(every), np.cumsum([len(raw) // 4 for raw in raws])
                bounds = np.searchsorted(cuts, np.append(0, lasts), side="right").tolist()
                for i, last in enumerate(lasts.tolist()):
                    n = len(raws[i]) // 4
                    recipe, b, base = [], 0, last - n
                    for e in cut_points(n, (cuts[bounds[i] : bounds[i + 1]] - base).tolist()):
                        part = body[(base + b) * size : (base + e) * size]
                        key = digest(part)
                        recipe.append(key + (e - b).to_bytes(4, "little"))
                        if key not in seen:
                            if len(seen) > 1_000_000:
                                seen.clear()
                            seen.add(key)
                            rows.append((0, key, None, e - b, part))
                        b = e
                    recipe = b"".join(recipe)
                    rows.append((1, hashlib.blake2b(repr(docs[at + i]).encode(), digest_size=8).digest(), docs[at + i], n, recipe))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _first_of_each(batches):
    """Within a task, to which all rows of a digest go: the first row of each chunk, every recipe."""
    seen = set()
    for batch in batches:
        keep = []
        for kind, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keep.append(kind == 1 or key not in seen)
            if kind == 0:
                seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2) -> None:
    spark, path = docs.sparkSession, path or default_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    wide = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) > 65536
    kind = "kind int, key binary, doc_id long, n long, body binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_chunks(path, end_id, wide), kind)
    rows.repartition(partitions(spark), "key").mapInArrow(_first_of_each, kind).write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/data")
    recipes = spark.read.schema(kind).parquet(f"{folder}/data").filter("kind = 1").select("doc_id", F.col("n").alias("n_tokens"), F.col("body").alias("recipe"))
    shards = max(partitions(spark), recipes.count() // SHARD_DOCS)
    recipes = recipes.repartitionByRange(shards, "doc_id", "recipe").sortWithinPartitions("doc_id", "recipe")
    recipes = recipes.withColumn("shard", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    recipes.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    delete(spark, f"{folder}/data/kind=1")
    roots = shard_roots(spark, folder)
    # one row for each shard
    roots.withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).coalesce(1).write.parquet(f"{folder}/manifest")


def _recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, recipe binary, shard int, row long").parquet(f"{folder}/recipes")


def shard_roots(spark: SparkSession, folder: str) -> DataFrame:
    """Per shard: counts and the Merkle root over its recipes in order. A shard holds some SHARD_DOCS documents at most."""

    def root(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        leaves = [_leaf(d, r) for d, r in zip(t["doc_id"].to_pylist(), t["recipe"].to_pylist())]
        return pa.table({"shard": [t["shard"][0].as_py()], "n_docs": [t.num_rows], "n_tokens": [sum(t["n_tokens"].to_pylist())], "root": [merkle(leaves)]}, schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())]))

    return _recipes(spark, folder).groupBy("shard").applyInArrow(root, "shard int, n_docs long, n_tokens long, root binary")


def roots_hold(spark: SparkSession, folder: str) -> bool:
    """Whether every shard's root and counts are those of the manifest."""
    m = spark.read.parquet(f"{folder}/manifest").select("shard", F.struct("n_docs", "n_tokens", "root").alias("was"))
    now = shard_roots(spark, folder).select("shard", F.struct("n_docs", "n_tokens", "root").alias("now"))
    return m.join(now, "shard", "full").filter("not (was <=> now)").isEmpty()


def verify(spark: SparkSession, folder: str) -> bool:
    """Whether every shard's root and counts are those of the manifest and every stored chunk has its digest."""
    return roots_hold(spark, folder) and read_chunks(spark, folder).filter("not ok").isEmpty()


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("key binary, doc_id long, n long, body binary, kind int").parquet(f"{folder}/data").filter("kind = 0").select("key", "n", "body")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Per stored chunk, from its bytes: digest, n ids, crc (of 32-bit ids), ok (the digest is that of the bytes)."""
    out = pa.schema([("digest", pa.binary()), ("size", pa.int64()), ("crc", pa.int64()), ("ok", pa.bool_())])

    def run(batches):
        for b in batches:
            rows = []
            for key, n, body in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids = np.frombuffer(body, f"<u{len(body) // n}").astype("<u4")
                rows.append((key, len(ids), zlib.crc32(ids.tobytes()), digest(body) == key))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    return _stored(spark, folder).mapInArrow(run, "digest binary, size long, crc long, ok boolean")


def _references(spark: SparkSession, folder: str) -> DataFrame:
    at = F.posexplode(F.sequence(F.lit(0), F.expr("length(recipe) div 20 - 1"))).alias("pos", "k")
    r = _recipes(spark, folder).filter("length(recipe) > 0").select("shard", "row", "doc_id", "recipe", at)
    return r.select("shard", "row", "doc_id", "pos", F.expr(f"substring(recipe, pos * 20 + 1, {DIGEST_BYTES})").alias("digest"))


def join_crc(parts) -> int:
    """CRC-32 of a concatenation from (crc, n bytes) of its parts: the CRC is affine in state and data."""
    crc = 0
    for c, n in parts:
        zeros = bytes(n)
        crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ c
    return crc


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. Fails on recipes that don't have their shard's Merkle root, and on a chunk whose bytes don't have its digest."""
    if not roots_hold(spark, folder):
        raise ValueError(f"{folder}: recipes do not match the manifest")
    @F.pandas_udf("long")
    def combined(parts: pd.Series) -> pd.Series:
        return pd.Series([join_crc((p["crc"], 4 * p["size"]) for p in x) for x in parts], dtype="int64")

    refs = _references(spark, folder).join(read_chunks(spark, folder), "digest")
    refs = refs.withColumn("size", F.when(F.col("ok"), F.col("size")).otherwise(F.raise_error(F.lit("chunk does not match its digest")).cast("long")))
    per = refs.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.sum("size").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("pos", "crc", "size"))).alias("parts"))
    per = per.select("shard", "row", "doc_id", "n_tokens", combined(F.col("parts")).alias("ids_crc32"))
    starts = spark.read.parquet(f"{folder}/manifest").select("shard", F.col("start").alias("shard_start"))
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("before", before).join(F.broadcast(starts), "shard").select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def decode(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its ids, put together from the stored chunks: doc_id, ids array<long>."""
    @F.pandas_udf("array<long>")
    def ids(parts: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([np.frombuffer(p["body"], f"<u{len(p['body']) // p['n']}") for p in x]).astype(np.int64) for x in parts])

    refs = _references(spark, folder).join(_stored(spark, folder).withColumnRenamed("key", "digest"), "digest")
    per = refs.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("pos", "n", "body"))).alias("parts"))
    return per.select("doc_id", ids(F.col("parts")).alias("ids"))
