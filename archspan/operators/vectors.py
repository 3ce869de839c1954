"""Nearest vectors of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

QUERIES_PER_BLOCK = 1024


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k nearest by cosine, ties by vec_id, over all vectors, without the query itself.

    Both inputs hold (vec_id, embedding). Queries go in blocks of bounded size; each
    block is broadcast and every partition keeps its own k best per query, of which
    a window takes the k best. Null and zero vectors are near nothing.
    """
    spark = vectors.sparkSession
    plain = vectors.where(F.col("embedding").isNotNull()).select("vec_id", "embedding")
    best = None

    def near(block: list) -> DataFrame:
        ids = np.array([r[0] for r in block], dtype=np.int64)
        mat = np.array([r[1] for r in block], dtype=np.float64)
        sent = spark.sparkContext.broadcast((ids, mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-300)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                v_ids = batch.column(0).to_numpy(zero_copy_only=False)
                v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                norm = np.linalg.norm(v, axis=1)
                sims = np.where(norm > 0, q @ (v / np.maximum(norm, 1e-300)[:, None]).T, -np.inf)
                sims[q_ids[:, None] == v_ids[None, :]] = -np.inf
                out_q, out_v, out_s = [], [], []
                for i, row in enumerate(np.round(sims, 6)):
                    order = np.lexsort((v_ids, -row))[:k]
                    order = order[np.isfinite(row[order])]
                    out_q.append(np.full(len(order), q_ids[i])), out_v.append(v_ids[order]), out_s.append(row[order])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], names=["query_id", "vec_id", "cosine"])

        return plain.mapInArrow(run, "query_id bigint, vec_id bigint, cosine double")

    block: list = []
    for row in queries.where(F.col("embedding").isNotNull()).select("vec_id", "embedding").toLocalIterator():
        block.append((row.vec_id, row.embedding))
        if len(block) == queries_per_block:
            best, block = near(block) if best is None else best.unionByName(near(block)), []
    if block:
        best = near(block) if best is None else best.unionByName(near(block))
    if best is None:
        return plain.where("false").select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("cosine"), F.lit(0).alias("rank"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")))
    return ranked.where(F.col("rank") <= k)
