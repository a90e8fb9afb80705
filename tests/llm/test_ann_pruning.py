"""Pruning of shards and trees: recall, what is visited, ties, copies and clusters."""

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import vptree_ann


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist(), 1.0, 2) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, score double, copy int")


def wanted(ids, x, modulus, k):
    out = {}
    for q in np.flatnonzero(ids % modulus == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[ids == ids[q]] = np.inf
        out[int(ids[q])] = [(int(ids[i]), d[i]) for i in np.lexsort((ids, d))[:k]]
    return out


def clustered(n, clusters=40, width=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (clusters, width))
    return np.arange(n), centres[rng.integers(0, clusters, n)] + rng.normal(0, 0.5, (n, width))


def test_clustered_vectors_visit_few_shards(spark):
    ids, x = clustered(6000)
    rows = vptree_ann.nearest_neighbours(frame(spark, ids, x), 100, 10, shard_rows=300).collect()
    want, found = wanted(ids, x, 100, 10), defaultdict(list)
    for r in rows:
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = sum(len({i for i, _ in want[q]} & {i for _, i, _ in found[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert np.mean([r.visited / r.shards for r in rows]) < 0.5 and rows[0].shards >= 15 and rows[0].factor <= 1
    assert all([s for _, _, s in sorted(v)] == sorted(s for _, _, s in v) and len(v) == 10 for v in found.values())


def test_factor_one_is_exact_in_pruned_shards(spark):
    ids, x = clustered(2000, seed=6)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vptree_ann.nearest_neighbours(frame(spark, ids, x), 50, 7, 1.0, shard_rows=100, block_queries=3).collect()}
    for q, near in wanted(ids, x, 50, 7).items():
        for rank, (i, d) in enumerate(near, 1):
            assert got[q, rank][0] == i and math.isclose(got[q, rank][1], d, abs_tol=1e-9)


def test_copies_and_ties_are_cut_and_go_by_id(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (900, 4))
    x[100:700] = x[7]  # two thirds are copies of one vector
    ids = np.arange(900)
    got = defaultdict(list)
    for r in vptree_ann.nearest_neighbours(frame(spark, ids, x), 100, 5, 1.0, shard_rows=60).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    want = wanted(ids, x, 100, 5)
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert [i for _, i in sorted(got[200])] == [7, 100, 101, 102, 103]


def test_repeated_ids_never_find_themselves(spark):
    ids, x = clustered(300, seed=9)
    ids = np.concatenate([ids, [100, 100, 5]])
    x = np.concatenate([x, x[[100, 7]], x[[5]]])
    rows = vptree_ann.nearest_neighbours(frame(spark, ids, x), 100, 6, 1.0, shard_rows=50).collect()
    assert all(r.vec_id != r.query_id for r in rows)
    assert sorted(r.rank for r in rows if r.query_id == 100) == list(range(1, 7)) == sorted(r.rank for r in rows if r.query_id == 200)
    one = vptree_ann.nearest_neighbours(frame(spark, ids[:1], x[:1]), 100, 6)
    assert one.count() == 0 and vptree_ann.nearest_neighbours(frame(spark, ids, x).filter(F.lit(False)), 100, 6).count() == 0


def test_chosen_factor_reads_less_than_everything():
    ids, x = clustered(4000, seed=3)
    factor, read = vptree_ann.choose_factor(ids, x, 10), []
    tree = vptree_ann.VantageTree(ids, x)
    for q in range(0, 4000, 80):
        tree.nearest(int(ids[q]), x[q], 10, factor, read=read)
    assert factor < 1 and np.mean(read) < 0.3
