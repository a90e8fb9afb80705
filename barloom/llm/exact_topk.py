"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components are integers. For each dimension a shard keeps its vectors ordered by component and cut
into segments of equal quantised component. A query's impact of a segment is the largest product
it can add. Segments are taken in order of descending impact, whatever their dimension, and add
their exact products to accumulators. What a dimension can still add to a vector it has not met is
at most the impact of the next segment, the same for all of them; so a vector's score is at most
its accumulator plus that impact for each dimension not met yet. The best accumulators so far are
rescored exactly, which gives a score that the k best reach. The search stops only when the vectors
whose bound reaches that score are few, or nothing is left; those vectors are rescored exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import finite_vectors, padded, search

#: Scale of components and width of a quantised level.
SCALE, LEVEL = 256, 16
#: Share of all postings read before the first proof is tried, and between two of them.
FIRST, STEP = 0.45, 0.06
#: The search may stop once the vectors that can still be among the best are this share or fewer:
#: rescoring so many costs less than a further step of postings.
RESCORE = 1 / 8
#: Best accumulators that are rescored for each proof.
LEADERS = 32


class ImpactIndex:
    """Vectors of one shard by dimension and descending component, with the ends of equal levels."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.x = ids, matrix.astype(np.int64)
        self.order = np.argsort(-self.x, axis=0, kind="stable").T.astype(np.int32)
        self.arrange()

    def arrange(self) -> None:
        """Values by dimension, and of all segments: dimension, largest and smallest value, length."""
        self.values = np.take_along_axis(self.x.T, self.order, axis=1)
        n = len(self.ids)
        last = [np.append(np.flatnonzero(np.diff(row)), n - 1) for row in self.values // LEVEL]
        first = [np.concatenate(([0], ends[:-1] + 1)) for ends in last]
        self.dimension = np.repeat(np.arange(len(last)), list(map(len, last)))
        self.length = np.concatenate([b - a + 1 for a, b in zip(first, last, strict=True)])
        self.high = np.concatenate([row[a] for row, a in zip(self.values, first, strict=True)])
        self.low = np.concatenate([row[b] for row, b in zip(self.values, last, strict=True)])
        # Narrow postings: reading them from memory is most of the work.
        self.values = np.ascontiguousarray(self.values, np.int16 if np.abs(self.values).max(initial=0) < 2**15 else np.float64)
        self.rows = np.ascontiguousarray(self.order, np.uint16 if n <= 2**16 else np.int32)
        self.at, self.add = np.empty(n, dtype=np.intp), np.empty(n)
        self.largest = np.abs(self.x).max(axis=0).astype(np.float64)
        self.exact = self.x.astype(np.float64)

    def __getstate__(self) -> dict:
        small = np.int32 if np.abs(self.x).max(initial=0) < 2**31 else np.int64
        return {"ids": self.ids, "x": self.x.astype(small), "order": self.order}

    def __setstate__(self, state: dict) -> None:
        self.ids, self.x, self.order = state["ids"], state["x"].astype(np.int64), state["order"]
        self.arrange()

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; in double precision where whole numbers below 2**53 suffice."""
        if np.abs(q) @ self.largest < 2**53:
            return (self.exact[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.x[rows] @ q

    def top(self, query_id: int, query: np.ndarray, k: int, step: float = STEP, rescore: float = RESCORE, read: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best others. ``read`` gets the share of postings that were read."""
        n, q = len(self.ids), query.astype(np.int64)
        others = self.ids != query_id
        wanted = min(k, int(others.sum()))
        if not wanted:
            return self.ids[:0], self.ids[:0]
        weight = q[self.dimension]
        impact = weight * np.where(weight > 0, self.high, self.low)
        by = np.argsort(-impact, kind="stable")
        upto = np.cumsum(self.length[by])
        done = np.zeros(len(q), dtype=np.int64)
        # One number holds both: how many dimensions a vector has been met in, times ``unit``, and its products' sum.
        most = float(np.abs(q) @ self.largest)
        unit = 2.0 ** np.ceil(np.log2(2 * most + 2))
        loss = 1 + unit * len(q) ** 2 * 2.0**-51  # what rounding may lose; less than one for ordinary vectors
        seen, met, bound = np.zeros((3, n))
        at, share, possible = 0, FIRST, np.flatnonzero(others)
        tried = max(LEADERS, wanted)
        most_left = max(wanted, int(rescore * n) if rescore < 1 else int(rescore))
        while at < len(by):
            end = max(at + 1, int(np.searchsorted(upto, share * upto[-1], side="right")))
            part = by[at:end]
            goal = done + np.bincount(self.dimension[part], self.length[part], len(q)).astype(np.int64)
            for d in np.flatnonzero((goal > done) & (q != 0)):
                # A negative component turns the order round.
                span = slice(done[d], goal[d]) if q[d] > 0 else slice(n - goal[d], n - done[d])
                rows, add = self.at[: goal[d] - done[d]], self.add[: goal[d] - done[d]]
                rows[:], add[:] = self.rows[d, span], self.values[d, span]
                add *= q[d]
                add += unit
                np.add.at(seen, rows, add)
            done, at, share = goal, end, share + step
            ahead = float(impact[by[at]]) if at < len(by) else 0.0
            # bound = products' sum + ahead * dimensions not met
            np.rint(np.multiply(seen, 1 / unit, out=met), out=met)
            np.add(seen, np.multiply(met, -unit - ahead, out=bound), out=bound)
            score = bound[possible] + ahead * met[possible]
            leaders = possible[np.argpartition(-score, min(tried, len(possible) - 1))[:tried]]
            reach = np.partition(self.scores(leaders, q), len(leaders) - wanted)[len(leaders) - wanted]
            possible = possible[bound[possible] >= reach - ahead * np.count_nonzero(q) - loss]
            if len(possible) <= most_left:
                break
        if read is not None:
            read.append(float(upto[at - 1] / upto[-1]))
        exact = self.scores(possible, q)
        best = np.lexsort((self.ids[possible], -exact))[:wanted]
        return self.ids[possible[best]], exact[best]


def exact_top_k(df: DataFrame, query_modulus: int, k: int, id_col: str = "vec_id", vec_col: str = "embedding", **sizes: int) -> DataFrame:
    """The ``k`` largest integer inner products of each query: ``query_id, rank, vec_id, score``.

    Each component x counts as floor(256 * x) in double precision. Queries are the rows whose id is
    divisible by ``query_modulus``; candidates are all rows but those with the query's own id.
    Ties go to the smaller id; a query with fewer candidates gets all of them. Rows whose id or
    vector is null, or whose vector holds null or non-finite components, take no part. A shorter
    vector counts as padded with zeros. A repeated id is one more query and candidate each time,
    so its ranks run over all of its rows' results. Other columns are ignored; an empty table gives
    an empty result.
    """
    rows = finite_vectors(df, id_col, vec_col)
    vectors = rows.select("id", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")).alias("v"))
    queries = F.pmod("id", F.lit(query_modulus)) == 0
    find = lambda index, query_id, query, k: index.top(query_id, padded(query, index.x.shape[1]), k)
    return search(vectors, queries, k, ImpactIndex, find, "long", largest=True, **sizes)
