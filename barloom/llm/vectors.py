"""Vector search in shards: one index per shard of vectors, blocks of queries against every shard.

Vectors are dealt to shards by a hash of their id, so a group of equal vectors is spread evenly.
Each shard's index is one row, built in its own task from a bounded number of vectors. A block of
queries is one row as well. A probing task gets one shard's index, once, and then up to
``BLOCKS_PER_TASK`` blocks one after the other; it yields the best of that shard for each query, and
those few rows are merged per query.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard and queries of a block, on average, and blocks that one task meets.
SHARD_ROWS, BLOCK_QUERIES, BLOCKS_PER_TASK = 16_384, 128, 4
#: Probing partitions at most; tasks beyond that share them.
MOST_PARTITIONS = 20_000


def finite_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` of the rows with an id and a vector whose components are all present and finite."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull()).filter(finite)


def deal(rows: DataFrame, per_part: int, name: str, build: Callable[[np.ndarray, np.ndarray], object]) -> tuple[DataFrame, int]:
    """One row ``(name, payload)`` per part of about ``per_part`` vectors, made by ``build(ids, matrix)``."""
    parts = max(1, -(-rows.count() // per_part))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        width = max(map(len, group["v"]))
        matrix = np.zeros((len(group), width))
        for k, v in enumerate(group["v"]):
            matrix[k, : len(v)] = v
        payload = pickle.dumps(build(group["id"].to_numpy(), matrix), protocol=5)
        return pd.DataFrame({name: group[name].iloc[:1], "payload": [payload]})

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", F.lit(name)), F.lit(parts)).cast("int"))
    return dealt.groupBy(name).applyInPandas(pack, f"{name} int, payload binary"), parts


def search(
    vectors: DataFrame, queries: Column, k: int, build: Callable[[np.ndarray, np.ndarray], object],
    find: Callable[[object, np.ndarray, int], tuple[np.ndarray, np.ndarray]], score_type: str, largest: bool,
    shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` best other vectors of each query: ``query_id, rank, vec_id, score``.

    ``find(index, query id, query, k)`` gives ids and scores of a shard's best; ties go to the smaller id.
    """
    index, shards = deal(vectors, shard_rows, "shard", build)
    blocks, n_blocks = deal(vectors.filter(queries), block_queries, "block", lambda ids, matrix: (ids, matrix))
    copies = -(-n_blocks // BLOCKS_PER_TASK)
    partitions = min(shards * copies, MOST_PARTITIONS)
    # A task's rows are its shard's index, then the blocks of its copy.
    place = (F.col("shard") * copies + F.col("copy")).alias("task")
    indexes = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(place, F.lit(-1).alias("block"), "payload")
    spread = blocks.withColumns({"copy": F.col("block") % copies, "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))}).select(place, "block", "payload")
    dealt = indexes.unionByName(spread).withColumn("partition", (F.col("task") % partitions).cast("int"))
    dealt = dealt.repartitionById(partitions, "partition").sortWithinPartitions("task", "block").select("task", "block", "payload")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[int | None, object] = (None, None)
        for batch in batches:
            for task, block, payload in zip(batch["task"], batch["block"], batch["payload"], strict=True):
                if block < 0:
                    held = (task, pickle.loads(payload))
                elif held[0] == task:  # a shard without vectors has no index
                    rows = []
                    for query_id, query in zip(*pickle.loads(payload), strict=True):
                        ids, scores = find(held[1], query_id, query, k)
                        rows.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": scores}))
                    yield pd.concat(rows)

    found = dealt.mapInPandas(probe, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score") if largest else F.asc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def padded(query: np.ndarray, width: int) -> np.ndarray:
    """The query with as many components as the index has; missing ones are 0."""
    return query[:width] if len(query) >= width else np.concatenate([query, np.zeros(width - len(query))])
