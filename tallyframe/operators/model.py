"""The unit outcome model: quality ridge, fit ridge on its out-of-fold residuals, boosted trees, a blend, and scoring."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import preset as P
from ..functions.clean import clip
from ..session import cut_lineage
from . import moments as MO
from .boosting import Boosted, BoostParams, boost
from .ranking import pct_mid, rank_in_reference

COLUMNS = [*P.QUALITY_FEATURES, *P.FIT_FEATURES, "win_pct"]
QUALITY = list(range(len(P.QUALITY_FEATURES)))
FIT = list(range(len(P.QUALITY_FEATURES), len(COLUMNS) - 1))


@dataclass(frozen=True)
class TrainParams:
    quality_alphas: tuple[float, ...] = (1.0, 3.0, 10.0, 30.0, 100.0)
    fit_alphas: tuple[float, ...] = (3.0, 10.0, 30.0, 100.0, 300.0, 1000.0)
    blends: tuple[float, ...] = (0.25, 0.5, 0.75)
    folds: int = 6
    inner_folds: int = 5
    trees: int = 150
    depth: int = 3
    step: float = 0.08
    min_leaf: int = 20


@dataclass
class UnitModel:
    quality: MO.Ridge
    fit: MO.Ridge
    boosted: Boosted
    blend: float
    validation: dict[str, float]
    reference: DataFrame = field(repr=False, default=None)  # kind, value


def sample_weight(target: Column) -> Column:
    return F.when((target >= 0.55) | (target <= 0.45), 1.5).otherwise(0.75)


def usable(rows: DataFrame) -> DataFrame:
    """Rows with an outcome; a feature that is no finite number counts as 50 (fixed), rows without a season are one season."""
    def finite(c: str) -> Column:
        v = F.col(c).cast("double")
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))

    features = {c: F.when(finite(c), F.col(c).cast("double")).otherwise(F.lit(50.0)) for c in COLUMNS[:-1]}
    return rows.where(finite(COLUMNS[-1])).withColumns({**features, "season": F.coalesce(F.col("season").cast("string"), F.lit(""))})


def line_column(line: np.ndarray, columns: list[str]) -> Column:
    return sum((F.col(c) * float(b) for c, b in zip(columns, line[1:]) if b != 0.0), F.lit(float(line[0])))


def _by_fold(fold_of: dict[str, int], values: list[Column]) -> Column:
    """A value per fold, chosen by the row's season."""
    fold = F.create_map(*[F.lit(x) for kv in fold_of.items() for x in kv])[F.col("season")]
    return F.coalesce(*[F.when(fold == i, v) for i, v in enumerate(values)])


def cross_validated_quality(m: dict, fold_of: dict[str, int], alphas, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Penalty with the smallest pooled out-of-fold error, and the prediction line of each fold."""
    n, folds = len(COLUMNS), sorted(set(fold_of.values()))
    best = None
    for alpha in alphas:
        lines, error = [], 0.0
        for f in folds:
            fitted = MO.fit_ridge(*MO.add_up(m, [s for s in m if fold_of[s] != f]), QUALITY, target, alpha)
            lines.append(MO.prediction_line(fitted, QUALITY, n))
            error += MO.squared_error(MO.add_up(m, [s for s in m if fold_of[s] == f])[1], target - lines[-1])
        if best is None or error < best[0]:
            best = (error, alpha, lines)
    return best[1], best[2]


def _residual_pieces(m: dict, seasons: list[str], alpha: float, folds: int, target: np.ndarray) -> list:
    """Residuals of out-of-fold quality predictions over the given seasons, as moment pieces."""
    sizes = {s: int(m[s][1][0, 0]) for s in seasons}
    inner = MO.grouped_folds(sizes, folds)
    pieces = []
    for f in sorted(set(inner.values())):
        q = MO.fit_ridge(*MO.add_up(m, [s for s in seasons if inner[s] != f]), QUALITY, target, alpha)
        line = target - MO.prediction_line(q, QUALITY, len(COLUMNS))
        pieces.append((MO.add_up(m, [s for s in seasons if inner[s] == f])[0], line))
    return pieces


def cross_validated_fit(m: dict, fold_of: dict[str, int], quality_alpha: float, alphas, inner_folds: int, target: np.ndarray):
    n = len(COLUMNS)
    quality, pieces, train = {}, {}, {}
    for f in sorted(set(fold_of.values())):
        seasons = [s for s in m if fold_of[s] != f]
        train[f] = MO.add_up(m, seasons)
        quality[f] = MO.prediction_line(MO.fit_ridge(*train[f], QUALITY, target, quality_alpha), QUALITY, n)
        pieces[f] = _residual_pieces(m, seasons, quality_alpha, inner_folds, target)
    best = None
    for alpha in alphas:
        lines, error = [], 0.0
        for f in sorted(train):
            fitted = MO.fit_ridge(*train[f], FIT, pieces[f], alpha)
            lines.append(quality[f] + MO.prediction_line(fitted, FIT, n))
            error += MO.squared_error(MO.add_up(m, [s for s in m if fold_of[s] == f])[1], target - lines[-1])
        if best is None or error < best[0]:
            best = (error, alpha, lines)
    return best[1], best[2]


def auc(df: DataFrame, label: str, score: str) -> float:
    """Area under the curve from average ranks (ties count half)."""
    from .ranking import with_ranks

    ranked = with_ranks(df.withColumn("_id", F.col("unit_id")), {"_r": (score, lambda lt, le, n: (lt + le + 1) / 2.0)}, [], ["_id"])
    s = ranked.agg(F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("r"), F.sum(label).alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = s["p"] or 0, s["n"] - (s["p"] or 0)
    return float((s["r"] - pos * (pos + 1) / 2.0) / (pos * neg)) if pos and neg else float("nan")


def evaluate(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """RMSE, MAE, R2 of predictions."""
    gap = F.col(actual) - F.col(predicted)
    return df.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"),
                  (1.0 - F.sum(gap * gap) / (F.var_pop(actual) * F.count(F.lit(1)))).alias("r2"))


def out_of_fold(rows: DataFrame, p: TrainParams = TrainParams()) -> tuple[DataFrame, dict]:
    """Out-of-fold predictions per unit: quality, linear (quality + fit) and boosted."""
    rows = cut_lineage(usable(rows).withColumn("weight", sample_weight(F.col("win_pct"))))
    m = MO.season_moments(rows, COLUMNS)
    target = MO.target_line(len(COLUMNS), len(COLUMNS) - 1)
    fold_of = MO.grouped_folds({s: int(v[1][0, 0]) for s, v in m.items()}, p.folds)
    q_alpha, q_lines = cross_validated_quality(m, fold_of, p.quality_alphas, target)
    f_alpha, o_lines = cross_validated_fit(m, fold_of, q_alpha, p.fit_alphas, p.inner_folds, target)
    fold = F.create_map(*[F.lit(x) for kv in fold_of.items() for x in kv])[F.col("season")]
    keep = ["unit_id", "season", "weight", *COLUMNS]
    boosted, tested = boost(rows.select(*keep), COLUMNS[:-1], "win_pct", "weight", fold, len(set(fold_of.values())), keep,
                            BoostParams(p.trees, p.depth, p.step, p.min_leaf))
    out = tested.withColumns({
        "quality_oof": _by_fold(fold_of, [line_column(x, COLUMNS) for x in q_lines]),
        "linear_oof": _by_fold(fold_of, [line_column(x, COLUMNS) for x in o_lines])}).withColumnRenamed("held_out", "boosted_oof")
    return cut_lineage(out), {"moments": m, "quality_alpha": q_alpha, "fit_alpha": f_alpha, "fold_of": fold_of, "quality_lines": q_lines, "rows": rows,
                             "boosted": boosted[-1]}


def train(rows: DataFrame, p: TrainParams = TrainParams(), held_out: tuple[DataFrame, dict] | None = None) -> UnitModel:
    """rows: unit_id, season, win_pct and the 39 features. `held_out`: what out_of_fold gave for these rows and parameters, if known."""
    oof, made = held_out or out_of_fold(rows, p)
    m, rows = made["moments"], made["rows"]
    target = MO.target_line(len(COLUMNS), len(COLUMNS) - 1)
    mix = lambda b: (1.0 - b) * F.col("linear_oof") + b * F.col("boosted_oof")
    errors = oof.agg(*[F.avg(F.pow(F.col("win_pct") - mix(b), F.lit(2.0))).alias(str(b)) for b in p.blends]).first()
    blend = min(p.blends, key=lambda b: errors[str(b)])

    weighted, plain = MO.add_up(m, list(m))
    quality = MO.fit_ridge(weighted, plain, QUALITY, target, made["quality_alpha"])
    fold_of = made["fold_of"]
    pieces = [(MO.add_up(m, [s for s in m if fold_of[s] == f])[0], target - line) for f, line in enumerate(made["quality_lines"])]
    fit = MO.fit_ridge(weighted, plain, FIT, pieces, made["fit_alpha"])

    held = oof.withColumns({"blended": mix(blend), "residual": F.col("win_pct") - mix(blend)})
    q = held.agg(F.percentile("residual", 0.1).alias("p10"), F.percentile("residual", 0.9).alias("p90"),
                 F.sqrt(F.avg(F.pow(F.col("win_pct") - F.col("quality_oof"), F.lit(2.0)))).alias("quality_rmse"),
                 F.avg("win_pct").alias("target_mean"), F.count(F.lit(1)).alias("units"), F.countDistinct("season").alias("seasons"),
                 F.count_if(F.col("win_pct") >= 0.55).alias("successful"), F.count_if(F.col("win_pct") <= 0.45).alias("unsuccessful")).first()
    inside = held.agg(F.avg(F.col("residual").between(q["p10"], q["p90"]).cast("double")).alias("c")).first()["c"]
    scores = evaluate(held, "win_pct", "blended").first()
    tails = held.where((F.col("win_pct") >= 0.55) | (F.col("win_pct") <= 0.45)).withColumn("_y", (F.col("win_pct") >= 0.55).cast("int"))
    validation = {"rmse": scores["rmse"], "mae": scores["mae"], "r2": scores["r2"], "quality_only_rmse": q["quality_rmse"],
                  "fit_rmse_improvement": q["quality_rmse"] - scores["rmse"], "tail_auc": auc(tails, "_y", "blended"),
                  "residual_p10": q["p10"], "residual_p90": q["p90"], "interval_coverage": inside, "units": q["units"], "seasons": q["seasons"],
                  "successful": q["successful"], "unsuccessful": q["unsuccessful"], "target_mean": q["target_mean"],
                  "quality_alpha": made["quality_alpha"], "fit_alpha": made["fit_alpha"], "blend": blend}
    model = UnitModel(quality, fit, made["boosted"], blend, validation)
    full = predict(rows, model)
    model.reference = cut_lineage(full.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("quality", "quality"), ("fit", "fit"), ("outcome", "outcome"))
    ])).alias("r")).select("r.*"))
    return model


def predict(features: DataFrame, model: UnitModel) -> DataFrame:
    n = len(COLUMNS)
    out = features.withColumns({
        "_gbt": model.boosted.prediction(),
        "quality": line_column(MO.prediction_line(model.quality, QUALITY, n), COLUMNS),
        "fit": line_column(MO.prediction_line(model.fit, FIT, n), COLUMNS)})
    linear = F.col("quality") + F.col("fit")
    return out.withColumn("outcome", (1.0 - model.blend) * linear + model.blend * F.col("_gbt")).drop("_gbt")


def channel_columns(fit: MO.Ridge) -> dict[str, Column]:
    """Signed contributions to the fit, in hundredths, summed per channel."""
    out = {c: F.lit(0.0) for c in P.CHANNELS}
    for i, name in enumerate(P.FIT_FEATURES):
        part = (F.col(name) - float(fit.mean[i])) / float(fit.scale[i]) * float(fit.coef[i]) * 100.0
        out[P.FIT_CHANNELS[name]] = out[P.FIT_CHANNELS[name]] + part
    return out


def score_units(features: DataFrame, model: UnitModel) -> DataFrame:
    """Scores of any number of units: three mid-rank scores against the training units, win share with its range, fit delta
    and channel contributions."""
    out = predict(features, model).withColumn("projected_win_pct", clip(F.col("outcome"), 0.10, 0.90))
    out = out.withColumns({f"channel_{k}": v for k, v in channel_columns(model.fit).items()})
    out = cut_lineage(out.withColumns({
        "win_low": clip(F.col("projected_win_pct") + float(model.validation["residual_p10"]), 0.10, 0.90),
        "win_high": clip(F.col("projected_win_pct") + float(model.validation["residual_p90"]), 0.10, 0.90)}))
    asked = out.select("unit_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in
        (("quality", "quality"), ("fit", "fit"), ("outcome", "projected_win_pct"))])).alias("r")).select(
        F.concat_ws(":", "unit_id", "r.kind").alias("_vid"), "unit_id", "r.*")
    ranked = rank_in_reference(asked, model.reference, ["kind"], "value", pct_mid)
    wide = ranked.groupBy("unit_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("pct"))).alias(name) for k, name in
                                           (("outcome", "synergy_score"), ("quality", "quality_score"), ("fit", "fit_score"))])
    return out.join(wide, "unit_id").withColumn("fit_delta_win_pct", F.col("fit"))
