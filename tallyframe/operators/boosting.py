"""Boosted regression trees under the Huber loss, for all folds and the whole set at once.

Features are put in bins by cuts that all rows share. A round is a job per tree level and one for the leaves: every task adds up
counts, weights and gradients by (model, column, node, bin), the sums meet by (model, column), and only the best cut of each column
leaves a task. So what moves depends on models, columns and bins, never on the number of rows, and the fold models cost no jobs of
their own. Predictions so far are a column of the rows, written as a stage every few rounds.

A leaf's value is the weighted median of its residuals plus the mean of what they exceed it by, clipped at the Huber bound; the
bound is a quantile of the absolute residuals. Quantiles are taken on a grid of steps, a fixed share of the target's range, so they
come out of sums too; a bound counts the residuals of the last grid, moved by the values of their leaves.

Rows need a finite target and a positive weight; features must not be null. Sums are of multiples of 2^-24, so they do not depend on
how rows are spread. Equal gains are settled by the first column and the lowest cut. No rows give trees of zeros."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

EXACT = 2.0**24  # weights and gradients are multiples of 1 / EXACT: their sums are exact up to 2^29


@dataclass(frozen=True)
class BoostParams:
    trees: int = 150
    depth: int = 3
    step: float = 0.08
    min_leaf: int = 20
    quantile: float = 0.9
    bins: int = 256
    grid: int = 2048
    stage_every: int = 15
    rows_a_task: int = 50_000


@dataclass
class Boosted:
    """Trees as full heaps: column and threshold of each inner node (a value at the threshold goes left), values of the leaves."""
    columns: list[str]
    initial: float
    step: float
    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.initial)
        for column, cut, value in zip(self.column, self.cut, self.value):
            out += self.step * value[leaf_of(x, column, cut)]
        return out

    def prediction(self) -> Column:
        """The prediction of a row as a column."""
        def run(frame: pd.DataFrame) -> pd.Series:
            return pd.Series(self.predict(frame.to_numpy(dtype=float)))

        return F.pandas_udf(run, "double")(F.struct(*[F.col(c).cast("double").alias(c) for c in self.columns]))


def leaf_of(x: np.ndarray, column: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The leaf, or the node of the level below the given ones, each row falls in."""
    at, rows = np.zeros(len(x), int), np.arange(len(x))
    first = 0
    while first < len(column):
        node = first + at
        at = 2 * at + (x[rows, column[node]] > cut[node])
        first = 2 * first + 1
    return at


def rounded(x: np.ndarray) -> np.ndarray:
    return np.rint(x * EXACT) / EXACT


def weighted_quantile(value: np.ndarray, weight: np.ndarray, q: float) -> float:
    """The smallest value that, with all below it, holds the share q of the weight."""
    if not len(value):
        return 0.0
    order = np.argsort(value, kind="stable")
    total = np.cumsum(weight[order])
    return float(value[order][min(np.searchsorted(total, q * total[-1]), len(value) - 1)])


def leaf_value(residual: np.ndarray, weight: np.ndarray, bound: float) -> float:
    """The Huber estimate of a leaf."""
    if not len(residual):
        return 0.0
    middle = weighted_quantile(residual, weight, 0.5)
    return middle + float(np.sum(weight * np.clip(residual - middle, -bound, bound)) / np.sum(weight))


def summed(model: np.ndarray, leaf: np.ndarray, place: np.ndarray, weight: np.ndarray) -> pd.DataFrame:
    """Weights of one model by leaf and place, in that order."""
    if not len(leaf):
        return pd.DataFrame({"model": model, "leaf": leaf, "place": place, "w": weight})
    first, span = place.min(), place.max() - place.min() + 1
    key, turn = np.unique(leaf.astype(np.int64) * span + (place - first), return_inverse=True)
    return pd.DataFrame({"model": np.full(len(key), model[0]), "leaf": key // span, "place": key % span + first, "w": np.bincount(turn, weight)})


def best_cuts(sums: np.ndarray, min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Gain and bin of the best cut of each node, from (count, weight, gradient) by node and bin; gain 0 or less where there is none."""
    left_n, left_w, left_g = np.cumsum(sums, axis=-1)
    right_n, right_w, right_g = (x[..., -1:] - x for x in (left_n, left_w, left_g))
    good = (left_n >= min_leaf) & (right_n >= min_leaf) & (left_w > 0) & (right_w > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = left_g / left_w - right_g / right_w
        gain = np.where(good, left_w * right_w / left_w[..., -1:] * gap * gap, -1.0)
    at = np.argmax(gain, axis=-1)
    return np.take_along_axis(gain, at[..., None], -1)[..., 0], at


def cuts(rows: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Thresholds of each column: halfway between neighbouring quantiles; between all neighbouring values where there are fewer than bins."""
    at = [(i + 1) / bins for i in range(bins)]
    found = rows.agg(*[F.percentile_approx(c, at, 100 * bins).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    out = []
    for values in found:
        v = np.unique(np.array(values or [], float))
        out.append((v[:-1] + v[1:]) / 2.0)
    return out


class _Rounds:
    """The rows with their bins and predictions, and what the tasks do with them."""

    def __init__(self, rows: DataFrame, columns: list[str], target: str, weight: str, fold: Column, folds: int, keep: list[str], p: BoostParams):
        self.columns, self.p, self.keep, self.models = columns, p, keep, folds + 1
        self.cuts = cuts(rows, columns, p.bins)
        low, high, count = rows.agg(F.min(target).cast("double"), F.max(target).cast("double"), F.count(F.lit(1))).first()
        self.low = low or 0.0
        self.unit = ((high or 0.0) - self.low) / p.grid or 1.0
        self.bins = max([1, *[len(c) + 1 for c in self.cuts]])
        edges, low = self.cuts, self.low

        def binned(batches):
            for frame in batches:
                x = frame[columns].to_numpy(dtype=float)
                held = np.column_stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(edges)]).astype("<u2")
                yield frame[keep + ["_y", "_w", "_fold"]].assign(_bins=[b.tobytes() for b in held], _raw=[np.full(folds + 1, low)] * len(frame))

        given = rows.select(*keep, F.col(target).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"),
                            F.coalesce(fold.cast("int"), F.lit(-1)).alias("_fold"), *[F.col(c).cast("double").alias(c) for c in columns if c not in keep])
        self.schema = given.select(*keep, "_y", "_w", "_fold", F.lit(b"").alias("_bins"), F.array(F.lit(0.0)).alias("_raw")).schema
        self.tasks = -(-count // p.rows_a_task) or 1
        given = given.repartition(self.tasks)  # a task's sums should weigh less than its rows
        self.rows = cut_lineage(given.mapInPandas(binned, self.schema))
        self.pending: list = []

    def met(self, part, part_schema: str, key: list[str], whole, schema: str) -> pd.DataFrame:
        """`part` of the rows of each task, `whole` of what meets by key. The rows of a single task meet in it, without a shuffle."""
        rows = self.rows.select("_y", "_w", "_fold", "_bins", "_raw")
        if self.tasks == 1:
            return rows.coalesce(1).mapInPandas(lambda batches: whole(part(batches)), schema).toPandas()
        return rows.mapInPandas(part, part_schema).repartition(*key).mapInPandas(whole, schema).toPandas()

    def reader(self):
        """A function from a batch to its bins, targets, weights, folds and predictions up to the last round."""
        wide, pending = len(self.columns), list(self.pending)

        def read(frame):
            x = np.frombuffer(b"".join(frame["_bins"]), "<u2").reshape(len(frame), wide)
            raw = np.stack(frame["_raw"].to_numpy()) if len(frame) else np.zeros((0, 1))
            for trees in pending:
                raw = raw + np.column_stack([value[leaf_of(x, column, cut)] for column, cut, value in trees])
            return x, frame["_y"].to_numpy(), frame["_w"].to_numpy(), frame["_fold"].to_numpy(), raw
        return read

    def add(self, trees: list) -> None:
        """trees: of each model (columns, bins of the cuts, values to add)."""
        self.pending.append(trees)
        if len(self.pending) >= self.p.stage_every:
            self.settle()

    def settle(self) -> None:
        if not self.pending:
            return
        read = self.reader()

        def moved(batches):
            for frame in batches:
                yield frame.assign(_raw=list(read(frame)[4]))

        self.rows, self.pending = cut_lineage(self.rows.mapInPandas(moved, self.schema)), []

    def best(self, grown: list, bound: np.ndarray) -> dict:
        """(model, node) -> (column, bin) of the best cut of the level below the grown nodes."""
        read, models, wide, bins, min_leaf = self.reader(), self.models, len(self.columns), self.bins, self.p.min_leaf
        nodes = len(grown[0][0]) + 1

        def added(batches):
            sums = np.zeros((models, 3, wide * nodes * bins))
            for frame in batches:
                x, y, w, fold, raw = read(frame)
                for k in range(models):
                    mine = fold != k
                    held, weight = x[mine], rounded(w[mine])
                    slope = rounded(weight * np.clip(y[mine] - raw[mine, k], -bound[k], bound[k]))
                    at = ((np.arange(wide) * nodes + leaf_of(held, *grown[k])[:, None]) * bins + held).ravel()
                    sums[k, 0] += np.bincount(at, minlength=wide * nodes * bins)
                    sums[k, 1] += np.bincount(at, np.repeat(weight, wide), wide * nodes * bins)
                    sums[k, 2] += np.bincount(at, np.repeat(slope, wide), wide * nodes * bins)
            by = sums.reshape(models, 3, wide, nodes, bins)
            for k in range(models):
                yield pd.DataFrame({"model": k, "at": range(wide), "sums": [by[k, :, i].tobytes() for i in range(wide)]})

        def chosen(batches):
            whole: dict = {}
            for frame in batches:
                for model, at, sums in zip(frame["model"], frame["at"], frame["sums"]):
                    part = np.frombuffer(sums).reshape(3, nodes, bins)
                    whole[model, at] = whole[model, at] + part if (model, at) in whole else part
            if whole:
                gain, cut = best_cuts(np.stack(list(whole.values()), axis=1), min_leaf)
                model, at = np.repeat(np.array(list(whole)), nodes, axis=0).T
                yield pd.DataFrame({"model": model, "at": at, "node": np.tile(range(nodes), len(whole)), "gain": gain.ravel(), "cut": cut.ravel()})

        # models x columns x nodes rows, whatever the number of rows
        got = self.met(added, "model int, at int, sums binary", ["model", "at"], chosen, "model int, at int, node int, gain double, cut int")
        got = got[got["gain"] > 0]
        got = got.sort_values(["gain", "at"], ascending=[False, True]).drop_duplicates(["model", "node"])
        return {(r.model, r.node): (r.at, r.cut) for r in got.itertuples()}

    def leaves(self, grown: list, bound: np.ndarray | None, step: float) -> tuple[np.ndarray, np.ndarray]:
        """Values of the leaves and the next Huber bound of each model. Without a bound: the median as start."""
        read, models, unit, q = self.reader(), self.models, self.unit, self.p.quantile
        count = len(grown[0][0]) + 1

        def placed(batches):
            for frame in batches:
                x, y, w, fold, raw = read(frame)
                for k in range(models):
                    mine = fold != k
                    leaf = leaf_of(x[mine], *grown[k])
                    place = np.rint((y[mine] - raw[mine, k]) / unit).astype(np.int64)
                    yield summed(np.full(len(leaf), k), leaf, place, rounded(w[mine]))

        def valued(batches):
            parts: dict = {}
            for frame in batches:
                for k, part in frame.groupby("model"):
                    both = pd.concat([parts[k], part]) if k in parts else part
                    parts[k] = summed(*[both[c].to_numpy() for c in both])
            for k, part in parts.items():
                leaf, residual, weight = part["leaf"].to_numpy(), part["place"].to_numpy() * unit, part["w"].to_numpy()
                if bound is None:
                    value = np.array([weighted_quantile(residual, weight, 0.5)])
                else:
                    value = np.array([leaf_value(residual[leaf == i], weight[leaf == i], bound[k]) for i in range(count)])
                after = weighted_quantile(np.abs(residual - step * value[leaf]), weight, q)
                yield pd.DataFrame({"model": [k], "value": [value], "bound": [after]})

        # a model's places are at most leaves x steps of the grid
        got = self.met(placed, "model int, leaf int, place long, w double", ["model"], valued, "model int, value array<double>, bound double")
        value, after = np.zeros((models, count)), np.zeros(models)
        for r in got.itertuples():
            value[r.model], after[r.model] = r.value, r.bound
        return value, after


def boost(rows: DataFrame, columns: list[str], target: str, weight: str, fold: Column, folds: int, keep: list[str],
          p: BoostParams = BoostParams()) -> tuple[list[Boosted], DataFrame]:
    """A model without each fold (0 .. folds - 1), then one of all rows; and `keep` with `held_out`, each row's prediction by the
    model that has not seen it (null for rows without a fold)."""
    r = _Rounds(rows, columns, target, weight, fold, folds, keep, p)
    none = (np.zeros(0, int), np.zeros(0, int))
    start, bound = r.leaves([none] * r.models, None, 1.0)
    r.add([(*none, v) for v in start])
    kept = []
    for _ in range(p.trees):
        grown = [none] * r.models
        for level in range(p.depth):
            found, grown_next = r.best(grown, bound), []
            for k, (column, cut) in enumerate(grown):
                here = [found.get((k, node), (0, p.bins)) for node in range(2**level)]  # no cut: all go left
                grown_next.append((np.append(column, [c for c, _ in here]).astype(int), np.append(cut, [b for _, b in here]).astype(int)))
            grown = grown_next
        value, bound = r.leaves(grown, bound, p.step)
        kept.append([(*grown[k], value[k]) for k in range(r.models)])
        r.add([(*grown[k], p.step * value[k]) for k in range(r.models)])
    r.settle()
    held = r.rows.select(*keep, F.when(F.col("_fold") >= 0, F.get("_raw", F.col("_fold"))).alias("held_out"))

    def threshold(column, cut):
        return float(r.cuts[column][cut]) if cut < len(r.cuts[column]) else float("inf")

    models = []
    for k in range(r.models):
        trees = [t[k] for t in kept]
        models.append(Boosted(columns, r.low + float(start[k][0]), p.step, np.array([t[0] for t in trees]),
                              np.array([[threshold(c, b) for c, b in zip(t[0], t[1])] for t in trees]), np.array([t[2] for t in trees])))
    return models, held
