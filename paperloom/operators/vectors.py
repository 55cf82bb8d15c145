"""Hash embeddings and exact nearest neighbours of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.constants import EMBEDDING_DIM, NEIGHBOURS
from paperloom.session import map_batches

#: Bytes of query vectors that are broadcast at once; a larger query set is searched in blocks of this size.
BLOCK_BYTES = 32_000_000


def bucket(token: Column, dim: int = EMBEDDING_DIM) -> Column:
    """A token's bucket: its md5 as a big-endian number modulo dim, in three parts that fit a BIGINT."""
    h = F.md5(token.cast("binary"))
    parts = [F.conv(F.substring(h, a, n), 16, 10).cast("long") for a, n in ((1, 12), (13, 10), (23, 10))]
    return (parts[0] % dim * F.lit(pow(2, 80, dim)) + parts[1] % dim * F.lit(pow(2, 40, dim)) + parts[2] % dim) % dim


def hash_embedding(df: DataFrame, key: str, text: str, dim: int = EMBEDDING_DIM) -> DataFrame:
    """key, bucket, weight: the non-zero entries of each text's unit vector of token counts; none for empty texts."""
    tokens = df.select(F.col(key), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z0-9_]+)"), 1)).alias("token"))
    counts = tokens.groupBy(key, bucket(F.col("token"), dim).alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("n") / norm).alias("weight"))


def _partial(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, metric: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each task keeps k neighbours a query: what leaves it is bounded by queries x k."""
        qid, q = shared.value
        best_d, best_i = np.full((len(qid), k), np.inf), np.full((len(qid), k), np.iinfo(np.int64).max)
        for batch in batches:
            own = np.array(batch.column(0).to_pylist(), np.int64)
            x = np.array(batch.column(1).to_pylist(), np.float64)
            for a in range(0, len(qid), 256):
                block = q[a : a + 256]
                if metric == "l2":
                    d = np.stack([((x - v) ** 2).sum(1) for v in block])
                else:
                    d = 1 - (block @ x.T) / np.maximum(np.linalg.norm(block, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None], 1e-300)
                d = np.concatenate([best_d[a : a + 256], d], 1)
                i = np.concatenate([best_i[a : a + 256], np.broadcast_to(own, (len(block), len(own)))], 1)
                order = np.lexsort((i, np.round(d, 9)), axis=1)[:, :k]
                best_d[a : a + 256], best_i[a : a + 256] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        kept = np.isfinite(best_d)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, k)[kept.ravel()]), pa.array(best_i[kept]), pa.array(best_d[kept])], names=["query_id", "neighbour", "distance"])

    return map_batches(rows, run, "query_id long, neighbour long, distance double")


def nearest(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int = NEIGHBOURS, metric: str = "l2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, neighbour, distance, rank: the k nearest rows of every query, exact; ties by the smaller key.

    metric: squared Euclidean ("l2") or cosine distance. Queries (same columns) are counted first and searched in
    blocks that fit block_bytes; rows without a vector are no neighbours; k is cut to the number of rows.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), F.col(vector))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("q"), F.col(vector).alias("v"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dim")).first()
    blocks = max(1, -(-size["n"] * size["dim"] * 8 // block_bytes))
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()  # at most about block_bytes
        if part:
            one = _partial(rows, np.array([r.q for r in part], np.int64), np.array([r.v for r in part], np.float64), k, metric)
            found = one if found is None else found.unionByName(one)
    if found is None:
        return df.sparkSession.createDataFrame([], "query_id long, neighbour long, distance double, rank int")
    w = W.partitionBy("query_id").orderBy(F.round("distance", 9), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
