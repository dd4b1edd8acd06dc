"""Exact inner-product search over dense vectors.

The question vectors travel to the data: blocks of a checked size are broadcast
and every task scores its own batches as one matrix product, keeping only its
best ``pool`` rows per question.  More questions than one block holds are
handled by further passes, so the result stays exact for any number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.functions.exact import SCALE
from clausegraph.operators.scale import top_per_key

BLOCK_QUERIES = 1024


def _merge_best(best, ids, scores, pool):
    """Keep the ``pool`` best (score desc, id asc) of the kept and the new columns, per question."""
    if best is not None:
        ids = np.concatenate([best[0], np.broadcast_to(ids, (scores.shape[0], ids.shape[-1]))], axis=1)
        scores = np.concatenate([best[1], scores], axis=1)
    else:
        ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, -scores), axis=1)[:, :pool]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _score_block(vectors: DataFrame, ids: list, matrix: np.ndarray, pool: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, queries = shared.value
        best = None
        for batch in batches:
            if not len(batch):
                continue
            block = np.stack(batch["embedding"].to_numpy()).astype("float64")
            raw = np.rint(queries @ block.T * SCALE).astype("int64")
            best = _merge_best(best, batch["vec_id"].to_numpy()[None, :], raw, pool)
        if best is not None:
            width = best[0].shape[1]
            yield pd.DataFrame({"query_id": np.repeat(np.asarray(query_ids), width),
                                "vec_id": best[0].ravel(), "raw": best[1].ravel()})

    return vectors.select("vec_id", "embedding").mapInPandas(run, "query_id bigint, vec_id bigint, raw bigint")


def dense_search(vectors: DataFrame, queries: DataFrame, pool: int, block: int = BLOCK_QUERIES) -> DataFrame:
    """``(query_id, vec_id, raw, rank)``: best ``pool`` vectors per question.

    ``vectors(vec_id, embedding)`` and ``queries(query_id, embedding)``; ``raw`` is
    the inner product in fixed point.
    """
    total = queries.count()
    passes = max(1, -(-total * 2 // block)) if total > block else 1
    parts = []
    for number in range(passes):
        slice_ = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == number) if passes > 1 else queries
        rows = slice_.select("query_id", "embedding").limit(block + 1).collect()
        if len(rows) > block:
            raise ValueError("question block exceeds its bound; raise block or spread the ids")
        if rows:
            matrix = np.array([r["embedding"] for r in rows], dtype="float64")
            parts.append(_score_block(vectors, [r["query_id"] for r in rows], matrix, pool))
    if not parts:
        empty = vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, raw bigint")
        parts = [empty]
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return top_per_key(scored, ["query_id"], [F.col("raw").desc(), F.col("vec_id").asc()], pool)


def roll_up(hits: DataFrame, unit_items: DataFrame, k: int) -> DataFrame:
    """Pool of units to items: strictly positive, best unit per item, top-k."""
    from clausegraph.operators.lexical import normalized_top

    items = hits.where(F.col("raw") > 0).join(unit_items, "vec_id").groupBy("query_id", "item_id").agg(
        F.max("raw").alias("raw"))
    return normalized_top(items, k)


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Mean vector per label as ``(query_id, embedding)``."""
    exploded = vectors.select(F.col(label).cast("bigint").alias("query_id"), F.posexplode("embedding").alias("pos", "x"))
    means = exploded.groupBy("query_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return packed.select("query_id", F.col("v.x").alias("embedding"))
