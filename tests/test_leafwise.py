"""Leaf-wise boosted trees against a plain version, and saved models."""

import json
import math
import random

import numpy as np
import pytest

from barloom.operators import leafwise
from barloom.operators.model import make_model, train_two_stages

NAMES = ["a", "b", "c", "d"]


def made_rows(n=2000, seed=4):
    pick = random.Random(seed)
    rows = []
    for k in range(n):
        a, b = pick.gauss(0, 1), pick.choice([0.0, 1.0, 2.0, 5.0])
        c, d = (None if pick.random() < 0.1 else pick.uniform(-1, 1)), pick.gauss(0, 1)
        up = int(pick.random() < 1 / (1 + math.exp(-(2 * (a > 0.3) * (b > 0.5) - 1 + (1.5 if c is None else c)))))
        rows.append(("s", k, a, b, c, d, up))
    return rows


def frame(spark, rows, parts):
    return spark.createDataFrame(rows, "symbol string, prediction_time long, a double, b double, c double, d double, target_up int").repartition(parts)


class Plain:
    """The same trees grown one split after the other, with loops over rows."""

    def __init__(self, model, rows, keys):
        self.m, self.y, self.keys = model, [r[6] for r in rows], keys
        self.x = [[math.nan if v is None else v for v in r[2:6]] for r in rows]
        self.margin = [model.base] * len(rows)

    def bin(self, feature, value):
        return 255 if math.isnan(value) else sum(e < value for e in self.m.edges[feature])

    def sums(self, rows):
        return sum(self.g[r] for r in rows), sum(self.h[r] for r in rows)

    def strength(self, g, h):
        return g * g / (h + self.m.l2)

    def best(self, rows, columns):
        found, (g, h) = None, self.sums(rows)
        for f in columns:
            bins = {r: self.bin(f, self.x[r][f]) for r in rows}
            for at in range(255):
                left = [r for r in rows if bins[r] <= at]
                right = len(rows) - len(left)
                gl, hl = self.sums(left)
                if min(len(left), right) < self.m.least_rows or min(hl, h - hl) / leafwise.SCALE < self.m.least_hessian:
                    continue
                s = leafwise.SCALE
                gain = self.strength(gl / s, hl / s) + self.strength((g - gl) / s, (h - hl) / s) - self.strength(g / s, h / s)
                if gain > 1e-10 and (found is None or gain > found[0]):
                    found = (gain, f, at)
        return found

    def tree(self, number):
        m = self.m
        p = [1 / (1 + math.exp(-v)) for v in self.margin]
        self.g = [round((p[r] - self.y[r]) * leafwise.SCALE) for r in range(len(p))]
        self.h = [round(p[r] * (1 - p[r]) * leafwise.SCALE) for r in range(len(p))]
        columns = sorted(np.random.default_rng([m.seed, number]).permutation(4)[: max(1, round(4 * m.column_share))].tolist())
        sampled = [r for r in range(len(p)) if leafwise.in_sample(self.keys[r : r + 1], number, m.seed, m.row_share)[0]]
        nodes = [{"rows": sampled, "all": list(range(len(p))), "best": self.best(sampled, columns)}]
        leaves = [0]
        while len(leaves) < m.leaves and any(nodes[k]["best"] for k in leaves):
            top = min((k for k in leaves if nodes[k]["best"]), key=lambda k: (-nodes[k]["best"][0], k))
            gain, f, at = nodes[top]["best"]
            leaves.remove(top)
            for side in (0, 1):
                part = {of: [r for r in nodes[top][of] if (self.bin(f, self.x[r][f]) > at) == side] for of in ("rows", "all")}
                nodes.append(part | {"best": self.best(part["rows"], columns)})
                leaves.append(len(nodes) - 1)
            nodes[top]["split"] = (f, at, gain)
        for k in leaves:
            g, h = self.sums(nodes[k]["rows"])
            nodes[k]["value"] = -m.step * (g / leafwise.SCALE) / (h / leafwise.SCALE + m.l2)
            for r in nodes[k]["all"]:
                self.margin[r] += nodes[k]["value"]
        return nodes


@pytest.fixture(scope="module")
def fitted(spark):
    rows = made_rows()
    return rows, leafwise.LeafwiseTrees(trees=3, leaves=6, step=0.3, least_rows=30, bins=16, seed=7).fit(frame(spark, rows, 5), NAMES)


def test_trees_equal_a_plain_version(spark, fitted):
    rows, model = fitted
    df = frame(spark, rows, 3)
    keys = {r.prediction_time: r.k for r in df.selectExpr("prediction_time", f"xxhash64({', '.join(sorted(df.columns))}) AS k").collect()}
    plain = Plain(model, rows, np.array([keys[k] for k in range(len(rows))]))
    assert len(model.grown) == 3
    for number, tree in enumerate(model.grown):
        nodes = plain.tree(number)
        assert len(nodes) == len(tree.feature) > 5
        for k, node in enumerate(nodes):
            assert tree.rows[k] == len(node["rows"])
            if "split" in node:
                f, at, gain = node["split"]
                assert (tree.feature[k], tree.bin[k]) == (f, at) and tree.gain[k] == pytest.approx(gain)
            else:
                assert tree.feature[k] == -1 and tree.value[k] == pytest.approx(node["value"], abs=1e-12)
    p = {r.prediction_time: r.predicted_probability_up for r in model.predict(df).collect()}
    assert all(p[k] == pytest.approx(1 / (1 + math.exp(-m)), abs=1e-9) for k, m in enumerate(plain.margin))


def test_partitions_do_not_matter(spark, fitted):
    rows, model = fitted
    again = leafwise.LeafwiseTrees(trees=3, leaves=6, step=0.3, least_rows=30, bins=16, seed=7).fit(frame(spark, rows[::-1], 1), NAMES)
    assert again.grown == model.grown


def test_stopping_and_importance(spark):
    rows = made_rows()
    train, check = frame(spark, rows[:1500], 2), frame(spark, rows[1500:], 2)
    model = leafwise.LeafwiseTrees(trees=14, leaves=8, step=0.9, least_rows=10, patience=2, bins=16).fit(train, NAMES, check)
    assert 1 <= model.best == len(model.grown) < 14
    p = [(r.target_up, r.predicted_probability_up) for r in model.predict(check).collect()]
    loss = -sum(math.log(v if y else 1 - v) for y, v in p) / len(p)
    assert model.best_score == pytest.approx(loss, abs=1e-6) and loss < 0.65
    found = model.importances()
    assert sum(n for *_, n in found) == sum(f >= 0 for t in model.grown for f in t.feature) and found == sorted(found, key=lambda x: -x[1])
    assert model.importance()[0] == found[0][:2] and {f for f, _ in model.importance()} == set(NAMES)


def test_saved_models_refuse_other_columns(spark, fitted, tmp_path):
    rows, model = fitted
    path = str(tmp_path / "model.json")
    model.save(spark, path, "coarse")
    with pytest.raises(FileExistsError):
        model.save(spark, path, "coarse")
    loaded = leafwise.LeafwiseTrees.load(spark, path, NAMES, "coarse")
    df = frame(spark, rows, 2)
    p = lambda m: sorted((r.prediction_time, r.predicted_probability_up) for r in m.predict(df).collect())
    assert p(loaded) == p(model)
    assert json.loads(open(path).read())["features"] == NAMES
    for columns, view in ((NAMES[::-1], None), (NAMES[:3], None), (NAMES, "fine")):
        with pytest.raises(ValueError):
            leafwise.LeafwiseTrees.load(spark, path, columns, view)
    with pytest.raises(ValueError, match="missing"):
        loaded.predict(df.drop("b"))
    with pytest.raises(FileNotFoundError):
        leafwise.LeafwiseTrees.load(spark, path + "x")


def test_odd_training_rows(spark):
    rows = made_rows(200)
    one_sided = frame(spark, [(*r[:6], 1) for r in rows], 1)
    with pytest.raises(ValueError, match="both outcomes"):
        leafwise.LeafwiseTrees(trees=1).fit(one_sided, NAMES)
    empty = frame(spark, [(*r[:2], None, 1.0, None, 2.0, r[6]) for r in rows], 2)  # nothing to split on
    model = make_model("leafwise_trees", trees=2, least_rows=10).fit(empty, NAMES)
    assert model.best == 0
    base = sum(r[6] for r in rows) / len(rows)
    assert {round(r.predicted_probability_up, 9) for r in model.predict(empty).collect()} == {round(base, 9)}


def test_two_stages(spark):
    rows = frame(spark, made_rows(900), 2).selectExpr("symbol", "timestamp_seconds(prediction_time * 1800) AS prediction_time", *NAMES, "target_up")
    fitted = train_two_stages(rows, NAMES, leafwise.LeafwiseTrees, trees=3, leaves=4, least_rows=20, step=0.5, bins=8)
    assert 1 <= fitted.best <= 3 and len(fitted.grown) == fitted.best
