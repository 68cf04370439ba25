"""Approximate nearest neighbours (operator 3): a block matrix join.

Vectors are packed into blocks (one row a block, of at most BLOCK vectors). Every query block meets every candidate block
as one tile of a block matrix product: the query blocks are copied to each candidate block's key, which is a join of a
stated query set with all rows in blocks, not a join of rows. In a tile, vectors scaled to int8 give approximate inner
products in one matrix product (of whole numbers under 2**24, so exact in float32) and, with the lengths of what
rounding left, an error bound for each pair. A pair whose upper bound lies under the query's k-th best lower bound in
the tile cannot be among its k nearest; the others are recomputed in double precision on the original vectors, and each
query keeps its k best in a heap. The tiles' answers for a query are merged the same way, a bounded number at a time.
So the answer is exact: recall is 1 by construction (tests hold it against brute force).

Vectors that are null, all zero, hold a null or a non-finite component, or have another dimension than the table's most
common one, take no part. Ties go to the smaller id; a query's own id is no candidate of it. Rows that repeat a vec_id
are candidates each with its own vector; as queries, repeated ids are answered once for the largest vector in component
order. Fewer than k candidates give fewer rows; an empty table gives none. Extra columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 4096
QUERY_BLOCK = 1024
#: Answers of tiles for one query that are merged at a time.
FAN_IN = 256


def _finite(vectors: DataFrame) -> DataFrame:
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))


def usable(vectors: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """vec_id and vector (double) of the rows that take part: those of the most common dimension of table, if it is given, or else of their own."""
    v = _finite(vectors)
    # one row
    dim = (v if table is None else _finite(table)).groupBy(F.size("vector").alias("dim")).count().agg(F.max_by("dim", F.struct("count", "dim")).alias("dim"))
    return v.join(F.broadcast(dim), F.size("vector") == F.col("dim")).select("vec_id", "vector")


def _pack(name: str, copies: int | None):
    """Rows of one block to one row: ids and vectors as bytes. copies: of one vector, only the smallest ids so many matter."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        ids = pdf["vec_id"].to_numpy(np.int64)
        mat = np.stack(pdf["vector"].to_list()).astype(np.float64)
        if copies:
            _, back = np.unique(mat + 0.0, axis=0, return_inverse=True)
            order = np.argsort(back.ravel(), kind="stable")
            b = back.ravel()[order]
            nth = np.arange(len(b)) - np.searchsorted(b, b)
            keep = np.sort(order[nth < copies])
            ids, mat = ids[keep], mat[keep]
        return pd.DataFrame({name: [int(pdf[name].iloc[0])], f"{name}_ids": [ids.tobytes()], f"{name}_mat": [mat.tobytes()]})

    return pack


def quantise(mat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values as float32, scale, length of the rounded vectors, length of what rounding left."""
    scale = np.abs(mat).max(axis=1) / 127
    q = np.rint(mat / scale[:, None])
    left = mat - q * scale[:, None]
    slack = 1 + 1e-9
    return q.astype(np.int8).astype(np.float32), scale, np.linalg.norm(q * scale[:, None], axis=1) * slack, np.linalg.norm(left, axis=1) * slack


def tile(q_ids, q_mat, c_ids, c_mat, k: int):
    """(query id, vec_id, score) of each query's k nearest candidates in this tile."""
    qi, qs, qn, qe = quantise(q_mat)
    ci, cs, cn, ce = quantise(c_mat)
    approx = (qi @ ci.T).astype(np.float64) * qs[:, None] * cs[None, :]
    bound = qn[:, None] * ce[None, :] + qe[:, None] * (cn + ce)[None, :]
    bound += 1e-9 * (np.abs(approx) + bound) + 1e-300
    low = approx - bound
    low[q_ids[:, None] == c_ids[None, :]] = -np.inf
    n = low.shape[1]
    kth = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(q_ids), -np.inf)
    rows, cols = np.nonzero((approx + bound >= kth[:, None]) & (q_ids[:, None] != c_ids[None, :]))
    out = []
    for a in range(0, len(rows), 65536):
        r, c = rows[a : a + 65536], cols[a : a + 65536]
        out.append((q_mat[r] * c_mat[c]).sum(axis=1))
    score = np.concatenate(out) if out else np.zeros(0)
    bounds = np.searchsorted(rows, np.arange(len(q_ids) + 1))
    found = []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        best = heapq.nsmallest(k, zip((-score[a:b]).tolist(), c_ids[cols[a:b]].tolist()))
        found += [(int(q_ids[i]), v, -s) for s, v in best]
    return found


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k nearest of vectors by inner product."""
    spark = vectors.sparkSession
    v = materialize(usable(vectors), "vectors")
    q = usable(queries, vectors).groupBy("vec_id").agg(F.max("vector").alias("vector"))
    rows, asked = v.count(), max(1, queries.count())
    n_c, n_q = max(1, -(-rows // BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    packed = "{0} int, {0}_ids binary, {0}_mat binary"
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")
    cand = v.withColumn("cb", deal(n_c)).groupBy("cb").applyInPandas(_pack("cb", k + 1), packed.format("cb"))
    ask = q.withColumn("qb", deal(n_q)).groupBy("qb").applyInPandas(_pack("qb", None), packed.format("qb"))
    cand, ask = materialize(cand, "candidate-blocks"), materialize(ask, "query-blocks")
    ask = ask.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    tiles = ask.join(cand.hint("shuffle_merge"), "cb")

    def run(frames):
        for pdf in frames:
            rows = []
            for t in pdf.itertuples(index=False):
                q_ids, c_ids = np.frombuffer(t.qb_ids, np.int64), np.frombuffer(t.cb_ids, np.int64)
                q_mat, c_mat = np.frombuffer(t.qb_mat, np.float64).reshape(len(q_ids), -1), np.frombuffer(t.cb_mat, np.float64).reshape(len(c_ids), -1)
                rows += [(*x, t.cb) for x in tile(q_ids, q_mat, c_ids, c_mat, k)]
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "part"])

    # blocks of megabytes: few to a batch
    found = tiles.select("qb_ids", "qb_mat", "cb", "cb_ids", "cb_mat").repartition(max(n_c * n_q // 4, 2 * spark.sparkContext.defaultParallelism), "cb", "qb_ids")
    found = found.mapInPandas(run, "query_id long, vec_id long, score double, part int")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nsmallest(k, zip((-pdf["score"]).tolist(), pdf["vec_id"].tolist()))
        return pd.DataFrame([(int(pdf["query_id"].iloc[0]), v, -s, int(pdf["part"].iloc[0])) for s, v in best], columns=["query_id", "vec_id", "score", "part"])

    parts = n_c
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        found = found.withColumn("part", F.pmod("part", F.lit(parts)).cast("int"))
        found = found.groupBy("query_id", "part").applyInPandas(merge, "query_id long, vec_id long, score double, part int")
    if n_c == 0:
        return found
    order = F.expr("transform(sort_array(collect_list(struct(-score as s, vec_id as v))), x -> struct(-x.s as score, x.v as vec_id))")
    best = found.groupBy("query_id").agg(order.alias("best"))
    best = best.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("i", "x"))
    return best.select("query_id", (F.col("i") + 1).alias("rank"), "x.vec_id", (F.col("x.score") + F.lit(0.0)).alias("score"))
