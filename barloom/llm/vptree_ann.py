"""Nearest neighbours with vantage-point trees in shards that are vantage points' neighbourhoods.

1. Pivots are drawn by a hash of the vectors' ids. Every vector goes to the shard of its nearest pivot;
   a large shard is cut by a hash of its rows, so copies of one vector are spread. A shard knows
   the range of its vectors' distances to its pivot.
2. Inside, each inner node of a tree has a vantage point; the vectors below it are halved by their
   distance to that point, and each half keeps the range of those distances.
3. By the triangle inequality a shard or a half holds nothing nearer to a query than the gap between
   its range and the query's own distance to the pivot or vantage point. It is skipped when
   this gap exceeds the k-th best distance times a factor: factor one is exact, smaller factors
   skip more and may miss neighbours. Without a given factor it is chosen by the recall on a sample.
4. A query first meets the shard with the smallest gap. Its k-th best distance there decides which
   other shards it is sent to, and where their search begins.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import finite_vectors

#: Vectors of a leaf.
LEAF = 128
#: Vectors of a shard, on average; pivots at most, beyond which shards grow; queries that one task sends through a tree.
SHARD_ROWS, MOST_PIVOTS, BLOCK_QUERIES = 16_384, 4_096, 512
#: Vectors and queries of the sample on which a factor is chosen, factors to choose from, and the recall it must reach there.
SAMPLE_ROWS, SAMPLE_QUERIES, FACTORS, RECALL = 16_384, 100, (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7, 1.0), 0.97
#: Room for rounding in the triangle inequality.
SLACK = 1e-9


def distances(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    gap = matrix - query
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


class VantageTree:
    def __init__(self, ids: np.ndarray, matrix: np.ndarray, leaf: int = LEAF):
        rows = np.arange(len(ids))
        #: (first row, end row) of a leaf or (vantage vector, two children with their ranges)
        self.nodes: list[tuple] = []
        self.leaf = leaf
        order: list[np.ndarray] = []
        self.root = self.build(matrix, rows, order, 0, np.random.default_rng(len(ids)))
        order = np.concatenate(order)
        self.ids, self.x = ids[order], np.ascontiguousarray(matrix[order])

    def build(self, matrix, rows, order, placed, random) -> int:
        stack_at = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= self.leaf:
            order.append(rows)
            self.nodes[stack_at] = (placed, placed + len(rows))
            return stack_at
        # Of a few candidates, the point whose distances spread most tells the halves apart best.
        some = matrix[random.choice(rows, min(len(rows), 100), replace=False)]
        tries = [matrix[i] for i in random.choice(rows, 5)]
        vantage = max(tries, key=lambda v: distances(some, v).std())
        d = distances(matrix[rows], vantage)
        by = np.argsort(d, kind="stable")
        half = len(rows) // 2
        children = []
        for part, at in ((by[:half], placed), (by[half:], placed + half)):
            child = self.build(matrix, rows[part], order, at, random)
            children.append((d[part].min(), d[part].max(), child))
        self.nodes[stack_at] = (vantage, children)
        return stack_at

    def nearest(self, query_id: int, query: np.ndarray, k: int, factor: float, bound: float = np.inf, read: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest found that are no farther than ``bound``; ``read`` gets the share of vectors looked at."""
        best_ids, best, most, looked = np.empty(0, dtype=np.int64), np.empty(0), bound, 0
        heap = [(0.0, self.root)]
        while heap:
            gap, at = heapq.heappop(heap)
            if gap > factor * bound + SLACK:
                break
            node = self.nodes[at]
            if isinstance(node[0], int):
                part = slice(*node)
                d, ids = distances(self.x[part], query), self.ids[part]
                looked += len(ids)
                keep = (ids != query_id) & (d <= bound)
                if keep.any():
                    d, ids = np.concatenate([best, d[keep]]), np.concatenate([best_ids, ids[keep]])
                    first = np.lexsort((ids, d))[:k]
                    best, best_ids = d[first], ids[first]
                    bound = min(most, best[-1]) if len(best) == k else most
                continue
            vantage, children = node
            to = float(np.sqrt(((query - vantage) ** 2).sum()))
            for low, high, child in children:
                heapq.heappush(heap, (max(gap, low - to, to - high), child))
        if read is not None:
            read.append(looked / max(1, len(self.ids)))
        return best_ids, best


def stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def choose_factor(ids: np.ndarray, x: np.ndarray, k: int, recall: float = RECALL) -> float:
    """The smallest factor that reaches the recall on a sample: a hundred queries in one tree against all its vectors."""
    tree, queries, want = VantageTree(ids, x), range(0, len(ids), max(1, len(ids) // SAMPLE_QUERIES)), {}
    for q in queries:
        d = distances(x, x[q])
        d[ids == ids[q]] = np.inf
        # Ties count as found, whichever of them is named.
        want[q] = np.sort(d)[: min(k, int(np.isfinite(d).sum()))]
    for factor in FACTORS:
        hits = sum(int((tree.nearest(int(ids[q]), x[q], k, factor)[1] <= want[q][-1] + SLACK).sum()) for q in queries if len(want[q]))
        if hits >= recall * sum(map(len, want.values())):
            return factor
    return 1.0


def sampled_factor(vectors: DataFrame, k: int) -> float:
    """``choose_factor`` of up to SAMPLE_ROWS vectors, drawn by a hash of their ids, in one task."""
    sample = vectors.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(SAMPLE_ROWS).withColumn("g", F.lit(0))
    pick = lambda group: pd.DataFrame({"factor": [choose_factor(group["id"].to_numpy(), stacked(group["v"]), k)]})
    rows = sample.groupBy("g").applyInPandas(pick, "factor double").collect()
    return rows[0].factor if rows else 1.0


def gaps(to_pivots: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least distance from queries to anything in shards, by their distances to the shards' pivots."""
    return np.maximum(0.0, np.maximum(low - to_pivots, to_pivots - high))


def probe(pairs: DataFrame, index: DataFrame, k: int, factor: float, block_queries: int) -> DataFrame:
    """``query_id, copy, vec_id, score`` of ``pairs(shard, id, copy, v, bound)``: the best of each pair's shard.

    A shard with many queries is sent to as many tasks as they fill; each builds nothing, it reads the tree.
    """
    load = pairs.groupBy("shard").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("parts"))
    dealt = pairs.join(load, "shard").withColumn("part", F.pmod(F.xxhash64("id", "copy"), F.col("parts")).cast("int")).drop("parts")
    trees = index.join(load, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("shard", "part", "payload")

    def search(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "copy": [], "vec_id": [], "score": []}
        if len(queries) and len(held):
            tree = pickle.loads(held["payload"].iloc[0])
            for query_id, copy, v, bound in zip(queries["id"], queries["copy"], stacked(queries["v"]), queries["bound"], strict=True):
                ids, d = tree.nearest(query_id, v, k, factor, bound)
                for name, values in zip(out, ([query_id] * len(ids), [copy] * len(ids), ids, d), strict=True):
                    out[name].extend(values)
        return pd.DataFrame(out).astype({"query_id": "int64", "copy": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["shard", "part"]
    return dealt.groupBy(keys).cogroup(trees.groupBy(keys)).applyInPandas(search, "query_id long, copy long, vec_id long, score double")


def search(vectors: DataFrame, queries: Column, k: int, factor: float | None, shard_rows: int, block_queries: int) -> DataFrame:
    """``query_id, rank, vec_id, score``, and in ``visited`` the shards that the query was sent to, of ``shards``."""
    spark, per = vectors.sparkSession, vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = per.width or 1
    rows = vectors.select("id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))).alias("v"))
    factor = sampled_factor(rows, k) if factor is None else factor
    wanted = max(1, min(MOST_PIVOTS, -(-per.n // shard_rows)))
    drawn = rows.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(wanted).collect()  # MOST_PIVOTS vectors at most
    pivots = np.unique(np.array([r.v for r in drawn], dtype=np.float64).reshape(-1, width), axis=0) if drawn else np.zeros((1, width))
    shared = spark.sparkContext.broadcast(pivots)

    @F.pandas_udf("pivot int, far double")
    def place(v: pd.Series) -> pd.DataFrame:
        x, best, far = stacked(v), np.zeros(len(v), dtype=np.int32), np.full(len(v), np.inf)
        for at, pivot in enumerate(shared.value):
            d = distances(x, pivot)
            nearer = d < far
            best[nearer], far[nearer] = at, d[nearer]
        return pd.DataFrame({"pivot": best, "far": far})

    placed = materialize(rows.withColumn("p", place("v")).select("id", "v", "p.*", F.monotonically_increasing_id().alias("copy"), queries.alias("query")), "ann-placed")
    size = max(shard_rows, -(-per.n // MOST_PIVOTS))
    cuts = placed.groupBy("pivot").agg(F.ceil(F.count("*") / size).cast("int").alias("cuts"))  # a row for each pivot
    sharded = placed.join(F.broadcast(cuts), "pivot").withColumn("shard", F.struct("pivot", F.pmod(F.xxhash64("copy"), F.col("cuts")).cast("int").alias("cut")))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = VantageTree(group["id"].to_numpy(), stacked(group["v"]))
        return pd.DataFrame({"pivot": group["pivot"].iloc[:1], "cut": group["cut"].iloc[:1], "low": [group["far"].min()], "high": [group["far"].max()], "payload": [pickle.dumps(tree, protocol=5)]})

    index = sharded.select("pivot", F.col("shard.cut").alias("cut"), "id", "v", "far").groupBy("pivot", "cut").applyInPandas(build, "pivot int, cut int, low double, high double, payload binary")
    index = materialize(index.withColumn("shard", F.xxhash64("pivot", "cut")), "ann-trees")
    ranges = index.select("shard", "pivot", "low", "high").orderBy("pivot", "cut").collect()  # four numbers for each shard
    table = spark.sparkContext.broadcast((
        np.array([r.shard for r in ranges], dtype=np.int64), np.array([r.pivot for r in ranges], dtype=np.int64), np.array([r.low for r in ranges]), np.array([r.high for r in ranges])))

    def gap_table(v: pd.Series) -> np.ndarray:
        _, pivot, low, high = table.value
        x = stacked(v)
        to = np.stack([distances(x, p) for p in shared.value], axis=1)
        return gaps(to[:, pivot], low, high)

    @F.pandas_udf("long")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series(table.value[0][gap_table(v).argmin(axis=1)])

    @F.pandas_udf("array<long>")
    def others(v: pd.Series, at: pd.Series, bound: pd.Series) -> pd.Series:
        near = gap_table(v) <= factor * bound.to_numpy()[:, None] + SLACK
        return pd.Series([table.value[0][row & (table.value[0] != h)].tolist() for row, h in zip(near, at, strict=True)])

    asked = placed.filter("query").select("id", "copy", "v")
    first = asked.select(home("v").alias("shard"), "id", "copy", "v", F.lit(float("inf")).alias("bound"))
    found = materialize(probe(first, index, k, factor, block_queries), "ann-first")
    bounds = found.groupBy("query_id", "copy").agg(F.when(F.count("*") >= k, F.max("score")).alias("bound")).withColumnRenamed("query_id", "id")
    known = first.drop("bound").join(bounds, ["id", "copy"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    more = known.withColumn("to", others("v", "shard", "bound"))
    second = more.select(F.explode("to").alias("shard"), "id", "copy", "v", "bound")
    both = found.unionByName(probe(second, index, k, factor, block_queries))
    visited = more.select(F.col("id").alias("query_id"), "copy", (F.size("to") + 1).alias("visited"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(visited, ["query_id", "copy"]).select("query_id", "rank", "vec_id", "score", "visited", F.lit(len(ranges)).alias("shards"), F.lit(factor).alias("factor"))


def nearest_neighbours(
    df: DataFrame, query_modulus: int, k: int, factor: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` nearest found of each query: ``query_id, rank, vec_id, score``, then ``visited, shards, factor``.

    ``score`` is the Euclidean distance of the original vectors in double precision. Queries are
    the rows whose id is divisible by ``query_modulus``; candidates are all rows but those with the
    query's own id. Ties go to the smaller id; a query with fewer candidates gets all of them.
    ``factor`` one is exact; without a factor it is the smallest whose recall is RECALL on a sample of
    at most SAMPLE_ROWS vectors. Rows whose id or vector is null, whose vector is zero or holds null or
    non-finite components take no part. A shorter vector counts as padded with zeros. A repeated id
    is one more query and candidate each time, so its ranks run over all of its rows' results.
    ``visited`` tells how many of the ``shards`` a query was sent to. Other columns are ignored; an empty table gives an empty result.
    """
    if factor is not None and not 0 < factor <= 1:
        raise ValueError("factor lies between 0 and 1")
    vectors = finite_vectors(df, id_col, vec_col).filter(F.exists("v", lambda x: x != 0))
    return search(vectors, F.pmod("id", F.lit(query_modulus)) == 0, k, factor, shard_rows, block_queries)
