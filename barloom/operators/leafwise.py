"""Boosted trees for probabilities, grown leaf by leaf from gradient histograms that Spark sums.

Features are cut into bins at quantiles, and a row becomes one byte a feature. A pass over the rows
adds up gradients, second derivatives and counts for every (leaf, feature, bin) that is wanted; tasks
send one row per (leaf, feature), and the best split of each is found where those meet. The driver
sees that one number of splits per leaf and feature, never a row.

Growth is best first: of all leaves the one with the largest gain is split, up to ``leaves``. With k
splits left only the k best leaves can still be chosen, so one pass looks at the children of all of
these and a tree takes about as many passes as it is deep.

Gradients are whole numbers of 2**-26. Their sums are exact in any order, up to 10**11 rows, so trees
depend neither on the partitioning nor on lost and repeated tasks.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.files import delete, read_text, write_text
from .model import ProbabilityModel, register

SCALE = float(1 << 26)
#: A format's name and version in a saved model's text.
FORMAT = "leafwise-trees/1"
#: Trees whose outputs are added in each pass before margins are written anew.
PENDING = 8


@dataclass
class Tree:
    """Nodes by number; node 0 is the root. ``feature`` is -1 in a leaf; a row goes left if its bin is at most ``bin``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, at: int, threshold: float, gain: float) -> tuple[int, int]:
        children = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.threshold[node], self.gain[node] = feature, at, threshold, gain
        self.left[node], self.right[node] = children
        for name in ("feature", "bin", "threshold", "left", "right", "value", "gain", "rows"):
            getattr(self, name).extend([-1, -1] if name == "feature" else [0, 0] if name in ("bin", "left", "right", "rows") else [0.0, 0.0])
        return children

    def leaves(self, columns: np.ndarray, cut: str = "bin") -> np.ndarray:
        """The leaf of every row of ``columns`` (rows by features), by bins or by ``threshold``."""
        at = np.zeros(len(columns), dtype=np.int64)
        feature, cuts, left, right = (np.array(x) for x in (self.feature, getattr(self, cut), self.left, self.right))
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            here = at[inner]
            goes = columns[inner, feature[here]] <= cuts[here]  # a missing value is no number and goes right
            at[inner] = np.where(goes, left[here], right[here])


@dataclass(frozen=True)
class Growth:
    leaves: int
    depth: int
    least_rows: int
    least_hessian: float
    l1: float
    l2: float

    def strength(self, g: float, h: float) -> float:
        return max(0.0, abs(g) - self.l1) ** 2 / (h + self.l2)

    def value(self, g: float, h: float) -> float:
        return -math.copysign(max(0.0, abs(g) - self.l1), g) / (h + self.l2)

    def best_split(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int] | None:
        """The gain and the last bin on the left of the best split; of equal ones the first."""
        gl, hl, nl = (np.cumsum(x)[:-1] for x in (g, h, n))
        gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
        allowed = (nl >= self.least_rows) & (nr >= self.least_rows) & (hl / SCALE >= self.least_hessian) & (hr / SCALE >= self.least_hessian)
        if not allowed.any():
            return None
        part = lambda a, b: np.maximum(0.0, np.abs(a / SCALE) - self.l1) ** 2 / (b / SCALE + self.l2)
        gain = np.where(allowed, part(gl, hl) + part(gr, hr) - self.strength(g.sum() / SCALE, h.sum() / SCALE), -np.inf)
        at = int(gain.argmax())
        return (float(gain[at]), at) if gain[at] > 1e-10 else None


def in_sample(keys: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Whether rows take part in a tree; by their keys, so wherever they are."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) % (1 << 63)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53) < share


def gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - y) * SCALE), np.rint(p * (1.0 - p) * SCALE)


def log_loss(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.rint(np.logaddexp(0.0, np.where(y > 0, -margin, margin)) * SCALE)


def bin_edges(rows: DataFrame, names: list[str], bins: int) -> list[list[float]]:
    """At most ``bins - 2`` ascending edges a feature, at quantiles of its values that are there; one aggregation for all."""
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    found = rows.agg(*[F.percentile_approx(value(c), shares, 100_000).alias(f"e{k}") for k, c in enumerate(names)]).first()
    return [sorted(set(found[k] or [])) for k in range(len(names))]


def to_bins(columns: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin b holds what is above edge b - 1 and at most edge b; missing values have the last bin, 255."""
    out = np.empty(columns.shape, dtype=np.uint8)
    for k, e in enumerate(edges):
        out[:, k] = np.where(np.isnan(columns[:, k]), 255, np.searchsorted(np.array(e), columns[:, k], side="left"))
    return out


def feature_matrix(batch: pd.DataFrame, names: list[str]) -> np.ndarray:
    return np.column_stack([batch[c].to_numpy(dtype=np.float64, na_value=np.nan) for c in names]) if len(batch) else np.empty((0, len(names)))


@dataclass
class LeafwiseTrees(ProbabilityModel):
    """P(up) by boosted trees with log-loss; rows and columns are sampled for each tree.

    ``fit`` with validation rows stops after ``patience`` trees without a smaller log-loss on them and
    keeps the trees up to the best; ``best`` is their number. Missing values go right. Rows that are
    equal in every column are sampled together.
    """

    trees: int = 100
    leaves: int = 31
    depth: int = -1
    step: float = 0.03
    least_rows: int = 100
    least_hessian: float = 1e-3
    l1: float = 0.0
    l2: float = 1.0
    row_share: float = 0.8
    column_share: float = 0.8
    bins: int = 255
    patience: int = 100
    seed: int = 2026
    names: list[str] = field(default_factory=list)
    base: float = 0.0
    grown: list[Tree] = field(default_factory=list)
    best: int | None = None
    best_score: float | None = None
    edges: list[list[float]] = field(default_factory=list)

    def fit(self, train: DataFrame, names: list[str], validation: DataFrame | None = None) -> LeafwiseTrees:
        if not 3 <= self.bins <= 255:
            raise ValueError("bins lie between 3 and 255")
        spark, self.names, self.grown = train.sparkSession, list(names), []
        known = train.agg(F.count("target_up").alias("n"), F.count_if(F.col("target_up") == 1).alias("up")).first()
        if not 0 < known.up < known.n:
            raise ValueError("training rows of both outcomes are needed")
        self.base = math.log(known.up / (known.n - known.up))
        self.edges = bin_edges(train, self.names, self.bins)
        shape = Growth(self.leaves, self.depth, self.least_rows, self.least_hessian, self.l1, self.l2)
        work = _Rows(spark, self._binned(train, validation), self.base, shape, len(self.names))
        best, best_at, losses = math.inf, 0, []
        try:
            for number in range(self.trees + 1):
                kept = sorted(np.random.default_rng([self.seed, number]).permutation(len(self.names))[: max(1, round(len(self.names) * self.column_share))].tolist())
                work.begin(number, self.seed, self.row_share, kept)
                found = work.splits(Tree(), [0])  # the root's histograms, and the log-loss of the trees before
                if validation is not None and number:
                    losses.append(work.loss)
                    if work.loss < best:
                        best, best_at = work.loss, number
                    elif number - best_at >= self.patience:
                        break
                if number == self.trees:
                    break
                tree = self._grow(work, shape, found)
                if len(tree.feature) == 1:
                    break
                self.grown.append(tree)
                work.add(tree)
        finally:
            work.close()
        if validation is not None:
            self.grown, self.best_score = self.grown[:best_at], best if best_at else None
        self.best = len(self.grown)
        return self

    def _binned(self, train: DataFrame, validation: DataFrame | None) -> DataFrame:
        names, edges = self.names, self.edges
        of = lambda df, check: df.select(
            *[F.col(c).cast("double").alias(c) for c in names], F.col("target_up").cast("int").alias("__y"), F.xxhash64(*sorted(df.columns)).alias("__key"), F.lit(check).alias("__check")).filter("__y IS NOT NULL")
        rows = of(train, False) if validation is None else of(train, False).unionByName(of(validation, True))

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                bins = to_bins(feature_matrix(b, names), edges)
                yield pd.DataFrame({"bins": [row.tobytes() for row in bins], "y": b["__y"], "key": b["__key"], "check": b["__check"]})

        return rows.mapInPandas(cut, "bins binary, y int, key long, check boolean")

    def _grow(self, work: _Rows, shape: Growth, found: dict[int, tuple]) -> Tree:
        """The tree of the best-first order. ``wide`` also has splits that were looked at and not chosen."""
        wide, known, looked = Tree(), dict(found), {}
        depth, tree, twin = {0: 0}, Tree(), {0: 0}
        if 0 not in known:
            return tree
        open_leaves = {0}
        for left_over in range(shape.leaves - 1, 0, -1):
            ranked = sorted((n for n in open_leaves if known[n][2] is not None and (shape.depth < 0 or depth[n] < shape.depth)), key=lambda n: (-known[n][2], n))
            if not ranked:
                break
            ahead = [n for n in ranked[:left_over] if n not in looked]
            if ranked[0] in ahead:
                for n in ahead:
                    _, _, gain, feature, at = known[n][:5]
                    looked[n] = wide.split(n, feature, at, self._threshold(feature, at), gain)
                    for child in looked[n]:
                        depth[child] = depth[n] + 1
                known |= work.splits(wide, [c for n in ahead for c in looked[n]])
            top = ranked[0]
            _, _, gain, feature, at = known[top][:5]
            children = tree.split(twin[top], feature, at, self._threshold(feature, at), gain)
            open_leaves.remove(top)
            for mine, child in zip(children, looked[top], strict=True):
                twin[child] = mine
                open_leaves.add(child)
        for node, mine in twin.items():
            g, h = known[node][:2]
            tree.value[mine], tree.rows[mine] = self.step * shape.value(g / SCALE, h / SCALE), known[node][5]
        return tree

    def _threshold(self, feature: int, at: int) -> float:
        """The largest value of a bin; above the last edge only missing values are left to tell apart."""
        return self.edges[feature][at] if at < len(self.edges[feature]) else math.inf

    def margins(self, columns: np.ndarray) -> np.ndarray:
        out = np.full(len(columns), self.base)
        for tree in self.grown:
            out += np.array(tree.value)[tree.leaves(columns, "threshold")]
        return out

    def predict(self, rows: DataFrame) -> DataFrame:
        missing = [c for c in self.names if c not in rows.columns]
        if missing:
            raise ValueError(f"columns that the model needs are missing: {', '.join(missing[:10])}")
        model, names = self, self.names

        @F.pandas_udf("double")
        def p(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series(1.0 / (1.0 + np.exp(-model.margins(feature_matrix(b, names)))))

        return rows.withColumn("predicted_probability_up", p(F.struct(*[F.col(c).cast("double").alias(c) for c in names])))

    def importance(self) -> list[tuple[str, float]]:
        return [(name, gain) for name, gain, _ in self.importances()]

    def importances(self) -> list[tuple[str, float, int]]:
        """``feature, gain, splits``: what its splits have gained in all, and how many there are; most gain first."""
        gain, splits = [0.0] * len(self.names), [0] * len(self.names)
        for tree in self.grown:
            for feature, g in zip(tree.feature, tree.gain, strict=True):
                if feature >= 0:
                    gain[feature] += g
                    splits[feature] += 1
        return sorted(zip(self.names, gain, splits, strict=True), key=lambda x: (-x[1], x[0]))

    def save(self, spark: SparkSession, path: str, view: str = "") -> None:
        """A text with everything that ``load`` needs; a file that is there already is an error."""
        params = {k: v for k, v in asdict(self).items() if k not in ("grown", "names", "edges")}
        text = {"format": FORMAT, "view": view, "features": self.names, "parameters": params, "trees": [asdict(t) for t in self.grown]}
        write_text(spark, path, json.dumps(text, indent=1, sort_keys=True))

    @classmethod
    def load(cls, spark: SparkSession, path: str, columns: list[str] | None = None, view: str | None = None) -> LeafwiseTrees:
        """The saved model. ``columns`` are the features of the data at hand: others, or others in order, are an error."""
        text = json.loads(read_text(spark, path))
        if text.get("format") != FORMAT:
            raise ValueError(f"{path} is no model of the format {FORMAT}")
        if columns is not None and list(columns) != text["features"]:
            raise ValueError(f"the model has other features or another order: {text['features'][:5]}..., not {list(columns)[:5]}...")
        if view is not None and view != text["view"]:
            raise ValueError(f"the model is of the view {text['view']!r}, not {view!r}")
        return cls(**text["parameters"], names=text["features"], grown=[Tree(**t) for t in text["trees"]])


class _Rows:
    """Binned rows in the shared folder, with the margin of all but the last few trees."""

    def __init__(self, spark: SparkSession, binned: DataFrame, base: float, shape: Growth, n_features: int):
        self.spark, self.shape, self.n_features = spark, shape, n_features
        self.folder, self.pending, self.loss, self.round = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}", [], math.inf, 0
        self.rows = self._written(binned.withColumn("margin", F.lit(float(base))))

    def _written(self, df: DataFrame) -> DataFrame:
        at = f"{self.folder}/{self.round}"
        self.round += 1
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def begin(self, number: int, seed: int, share: float, columns: list[int]) -> None:
        self.number, self.seed, self.share, self.columns = number, seed, share, columns

    def add(self, tree: Tree) -> None:
        self.pending.append(tree)
        if len(self.pending) >= PENDING:
            trees, before = self.pending, f"{self.folder}/{self.round - 1}"

            def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    yield b.assign(margin=_margin(b, _bins(b), trees))

            self.rows, self.pending = self._written(self.rows.mapInPandas(moved, self.rows.schema)), []
            delete(self.spark, before)

    def close(self) -> None:
        delete(self.spark, self.folder)

    def splits(self, tree: Tree, wanted: list[int]) -> dict[int, tuple]:
        """``g, h, gain, feature, bin, rows`` of each wanted leaf of ``tree`` that rows reach; the gain is null without a split."""
        slots, columns, width = {leaf: k for k, leaf in enumerate(wanted)}, self.columns, 256
        number, seed, share, pending, shape = self.number, self.seed, self.share, list(self.pending), self.shape
        slot_of = np.full(len(tree.feature), -1)
        for leaf, k in slots.items():
            slot_of[leaf] = k

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((3, len(columns), len(wanted), width), dtype=np.int64)
            loss = [0, 0]
            for b in batches:
                if not len(b):
                    continue
                bins = _bins(b)
                margin, y, check = _margin(b, bins, pending), b["y"].to_numpy(), b["check"].to_numpy()
                if check.any():
                    loss[0] += int(log_loss(margin[check], y[check]).sum())
                    loss[1] += int(check.sum())
                slot = slot_of[tree.leaves(bins)]
                use = ~check & (slot >= 0) & in_sample(b["key"].to_numpy(), number, seed, share)
                g, h = gradients(margin[use], y[use])
                place = slot[use] * width
                for k, c in enumerate(columns):
                    at = place + bins[use, c]
                    for total_of, weights in zip(total, (g, h, None), strict=True):
                        total_of[k] += np.bincount(at, weights=weights, minlength=len(wanted) * width).astype(np.int64).reshape(len(wanted), width)
            rows = [(slot, k, *(total[j, k, slot].tobytes() for j in range(3))) for slot in range(len(wanted)) for k in range(len(columns)) if total[2, k, slot].any()]
            rows.append((-1, 0, *(np.array([v], dtype=np.int64).tobytes() for v in (*loss, 0))))
            yield pd.DataFrame(rows, columns=["slot", "k", "g", "h", "n"])

        def best(parts: pd.DataFrame) -> pd.DataFrame:
            g, h, n = (np.sum([np.frombuffer(x, dtype=np.int64) for x in parts[c]], axis=0) for c in "ghn")
            slot, k = int(parts["slot"].iloc[0]), int(parts["k"].iloc[0])
            split = shape.best_split(g[:-1], h[:-1], n[:-1]) if slot >= 0 and not n[-1] else shape.best_split(g, h, n) if slot >= 0 else None
            gain, at = split or (None, None)
            out = pd.DataFrame({"slot": [slot], "k": [k], "g": [int(g.sum()) if slot >= 0 else int(g[0])], "h": [int(h.sum()) if slot >= 0 else int(h[0])], "n": [int(n.sum())], "gain": [gain], "bin": [at]})
            return out.astype({"gain": "Float64", "bin": "Int64"})

        made = self.rows.mapInPandas(sums, "slot int, k int, g binary, h binary, n binary")
        found = made.groupBy("slot", "k").applyInPandas(best, "slot int, k int, g long, h long, n long, gain double, bin long").collect()  # a row per leaf and feature
        out: dict[int, tuple] = {}
        for r in sorted(found, key=lambda r: (r.slot, r.gain is None, -(r.gain or 0.0), r.k)):
            if r.slot < 0:
                self.loss = r.g / SCALE / r.h if r.h else math.inf
            elif wanted[r.slot] not in out:
                out[wanted[r.slot]] = (r.g, r.h, r.gain, columns[r.k], r.bin, r.n)
        return out


def _bins(batch: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(batch["bins"]), dtype=np.uint8).reshape(len(batch), -1)


def _margin(batch: pd.DataFrame, bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    out = batch["margin"].to_numpy().copy()
    for tree in trees:
        out += np.array(tree.value)[tree.leaves(bins)]
    return out


register("leafwise_trees", LeafwiseTrees)
