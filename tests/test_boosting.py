"""Boosted trees of all folds at once against one model at a time, row by row."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import boosting as B

COLS = ["a", "b", "c"]


def data(n, seed=3):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)), 2)
    y = 0.5 + 0.2 * (x[:, 0] > 0.3) - 0.1 * x[:, 1] + 0.02 * r.normal(size=n)
    y[r.integers(0, n, n // 20)] += 3.0  # far off
    return pd.DataFrame(x, columns=COLS).assign(id=range(n), y=y, w=r.choice([0.75, 1.5], n), fold=r.integers(0, 3, n))


def quantile(values, weights, q):
    total, so_far = sum(weights), 0.0
    for v, w in sorted(zip(values, weights)):
        so_far += w
        if so_far >= q * total:
            return v
    return 0.0


def plain(train, asked, halves, unit, low, p):
    """One model, grown node by node; quantiles on the grid."""
    x, y, w = train[COLS].to_numpy(), train.y.to_numpy(), train.w.to_numpy()
    new = asked[COLS].to_numpy()
    grid = lambda v: np.rint(v / unit) * unit
    start = low + quantile(grid(y - low), w, 0.5)
    raw, out = np.full(len(y), start), np.full(len(new), start)
    bound = quantile(abs(low + grid(y - low) - start), w, p.quantile)
    for _ in range(p.trees):
        g = np.clip(y - raw, -bound, bound)
        at = grid(y - raw)
        moved = np.zeros(len(y))

        def grow(mine, theirs, level):
            best = (1e-12, None)
            if level < p.depth:
                for c in range(3):
                    for cut in halves[c]:
                        left = mine & (x[:, c] <= cut)
                        right = mine & ~left
                        if left.sum() >= p.min_leaf and right.sum() >= p.min_leaf:
                            a, b = w[left].sum(), w[right].sum()
                            gain = a * b / (a + b) * ((w * g)[left].sum() / a - (w * g)[right].sum() / b) ** 2
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, (c, cut))
            if best[1]:
                c, cut = best[1]
                grow(mine & (x[:, c] <= cut), theirs & (new[:, c] <= cut), level + 1)
                grow(mine & (x[:, c] > cut), theirs & (new[:, c] > cut), level + 1)
                return
            middle = quantile(at[mine], w[mine], 0.5)
            value = middle + np.average(np.clip(at[mine] - middle, -bound, bound), weights=w[mine])
            moved[mine] = p.step * value
            out[theirs] += p.step * value

        grow(np.ones(len(y), bool), np.ones(len(new), bool), 0)
        raw = raw + moved
        bound = quantile(abs(at - moved), w, p.quantile)
    return out


@pytest.mark.parametrize("depth,min_leaf", [(3, 8), (2, 40)])
def test_all_folds_at_once_equal_one_model_at_a_time(spark, depth, min_leaf):
    pdf = data(160)
    p = B.BoostParams(trees=5, depth=depth, step=0.3, min_leaf=min_leaf, stage_every=3, rows_a_task=50)
    rows = spark.createDataFrame(pdf).repartition(5)
    models, held = B.boost(rows, COLS, "y", "w", F.col("fold"), 3, ["id", "y"], p)
    held = held.toPandas().set_index("id")["held_out"]
    values = [np.unique(pdf[c]) for c in COLS]
    halves, unit = [(v[:-1] + v[1:]) / 2 for v in values], (pdf.y.max() - pdf.y.min()) / p.grid
    for k in range(3):
        asked = pdf[pdf.fold == k]
        want = plain(pdf[pdf.fold != k], asked, halves, unit, pdf.y.min(), p)
        assert np.allclose(held[asked.id].to_numpy(), want, atol=1e-6)
        assert np.allclose(models[k].predict(asked[COLS].to_numpy()), want, atol=1e-6)
    want = plain(pdf, pdf, halves, unit, pdf.y.min(), p)
    got = rows.select("id", models[3].prediction().alias("v")).toPandas().set_index("id")["v"]
    assert np.allclose(got[pdf.id].to_numpy(), want, atol=1e-6)


def test_rows_spread_otherwise_give_the_same_trees(spark):
    pdf = data(120, 5)
    p = B.BoostParams(trees=4, min_leaf=5, stage_every=2, rows_a_task=30)
    a, b = (B.boost(spark.createDataFrame(pdf.sample(frac=1, random_state=i)).repartition(n), COLS, "y", "w", F.col("fold"), 3, ["id"], p)[0]
            for i, n in enumerate((1, 7)))
    for x, y in zip(a, b):
        assert (x.column == y.column).all() and (x.cut == y.cut).all() and np.allclose(x.value, y.value, atol=1e-9)


def test_far_off_rows_move_huber_trees_less_than_their_mean_would(spark):
    pdf = data(300, 8)
    model = B.boost(spark.createDataFrame(pdf), COLS, "y", "w", F.lit(None), 0, ["id"], B.BoostParams(trees=15, step=0.4))[0][0]
    true = 0.5 + 0.2 * (pdf.a > 0.3) - 0.1 * pdf.b
    gap = model.predict(pdf[COLS].to_numpy()) - true
    assert abs(gap).mean() < 0.06 and abs((pdf.y - true).mean()) > 0.1


def test_small_tables(spark):
    schema = "id long, y double, w double, fold int, a double, b double, c double"
    models, held = B.boost(spark.createDataFrame([], schema), COLS, "y", "w", F.col("fold"), 2, ["id"], B.BoostParams(trees=1))
    assert len(models) == 3 and held.count() == 0 and models[2].predict(np.zeros((2, 3))).tolist() == [0.0, 0.0]
    one = spark.createDataFrame([(1, 0.25, 1.0, 0, 1.0, 1.0, 1.0)] * 3 + [(2, 0.25, 1.0, None, 2.0, 1.0, 1.0)], schema)
    models, held = B.boost(one, COLS, "y", "w", F.col("fold"), 1, ["id"], B.BoostParams(trees=2, min_leaf=1))
    assert models[1].predict(np.ones((1, 3))).tolist() == [0.25]
    assert {(r.id, r.held_out) for r in held.collect()} == {(1, 0.25), (2, None)}
