"""Composite scores as Column expressions. Percentiles come in as 0..100 columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import preset as P
from .clean import clip


def credibility(minutes: Column, full: float = P.CAREER_CREDIBILITY_MINUTES) -> Column:
    return F.least(F.lit(1.0), F.sqrt(F.greatest(F.coalesce(minutes, F.lit(0.0)), F.lit(0.0)) / full))


def longevity(minutes: Column) -> Column:
    return credibility(minutes, P.LONGEVITY_MINUTES)


def impact_score(pct: dict[str, Column], trust: Column | None = None) -> Column:
    """Impact and versatility from global percentiles, pulled to the median by `trust`.
    Axes that are absent or null count as the median."""
    trust = F.lit(1.0) if trust is None else trust

    def axis(name: str) -> Column:
        value = F.coalesce(pct[name], F.lit(50.0)) if name in pct else F.lit(50.0)
        return 0.5 + trust * (value / 100.0 - 0.5)

    pts, ts, efg, ast, ast_pct, reb, stl, blk, fg3a, tov = map(axis, (
        "pts_per36", "ts_pct", "efg_pct", "ast_per36", "ast_pct", "reb_per36", "stl_per36",
        "blk_per36", "fg3a_rate", "tov_per36"))
    scoring = pts * (0.55 + 0.45 * ts)
    playmaking = 0.6 * ast + 0.4 * ast_pct
    spacing = fg3a * (0.4 + 0.6 * efg)
    defense = 1.0 - (1.0 - stl) * (1.0 - blk)
    parts = {
        "scoring": scoring, "playmaking": playmaking, "efficiency": ts, "rebounding": reb,
        "steals": stl, "blocks": blk, "spacing": spacing, "ball_security": 1.0 - tov,
    }
    impact = reduce(add, [parts[k] * w for k, w in P.IMPACT_WEIGHTS.items()])
    creation = 0.5 * F.greatest(scoring, playmaking) + 0.5 * (0.6 * scoring + 0.4 * playmaking)
    macro = [creation, ts, defense, reb, spacing]
    breadth = F.exp(reduce(add, [F.log(F.greatest(m, F.lit(1e-3))) for m in macro]) / len(macro))
    return F.pow(impact, F.lit(P.IMPACT_EXPONENT)) * F.pow(breadth, F.lit(P.VERSATILITY_EXPONENT))


def workload(mpg_pct: Column, minutes: Column) -> Column:
    share = clip(F.coalesce(mpg_pct, F.lit(0.0)), 0.0, 100.0) / 100.0
    return F.pow(share, F.lit(P.WORKLOAD_MPG_EXPONENT)) * F.pow(
        longevity(minutes), F.lit(P.WORKLOAD_VOLUME_EXPONENT))


def rank_curve(position: Column, n: Column, exponent: float = P.RANK_CURVE) -> Column:
    return F.least(F.pow(position / n, F.lit(exponent)) * P.SCORE_CEILING, F.lit(P.SCORE_CEILING))


def anchored_curve(share: Column, value: Column, exponent: float = P.LEGACY_CURVE,
                   anchor: float | None = None) -> Column:
    """`share` is the 0..1 fraction of the pool at or below `value`."""
    score = F.pow(share, F.lit(exponent))
    if anchor is not None and anchor > 0:
        score = F.sqrt(score * clip(value / anchor, 0.0, 1.0))
    return F.least(score * P.SCORE_CEILING, F.lit(P.SCORE_CEILING))


def prospect_damper(mpg: Column, gp: Column, ts: Column) -> Column:
    """Minutes, games and efficiency damping on raw values; unknown games or efficiency is neutral."""
    minutes = F.pow(clip(mpg / 24.0, 0.0, 1.0), F.lit(1.4))
    games = F.when(gp > 0, F.sqrt(clip(gp / 25.0, 0.0, 1.0))).otherwise(1.0)
    shooting = F.when(ts > 0, clip(ts / 0.60, 0.0, 1.0)).otherwise(1.0)
    return minutes * games * shooting


def polygon_score(pct: dict[str, Column]) -> Column:
    """Mean product of neighbouring axes: the share of the full hexagon the shape fills."""
    axes = [F.coalesce(pct[k], F.lit(0.0)) / 100.0 if k in pct else F.lit(0.0) for k in P.SKILL_AXES]
    return reduce(add, [a * b for a, b in zip(axes, axes[1:] + axes[:1])]) / len(axes)


def polygon_workload(pct: dict[str, Column]) -> Column:
    return polygon_score(pct) * F.pow(F.coalesce(pct["mpg"], F.lit(0.0)) / 100.0, F.lit(1.5))


def skill_ratings(pct: dict[str, Column], score: Column | None,
                  contrast: float = P.SHAPE_CONTRAST) -> dict[str, Column]:
    axes = {k: clip(F.coalesce(pct[k], F.lit(0.0)), 0.0, 100.0) for k in P.SKILL_AXES}
    mean = reduce(add, axes.values()) / len(axes)
    level = mean if score is None else F.coalesce(score * 100.0, mean)
    return {k: clip(level + contrast * (v - mean), 0.0, 100.0) for k, v in axes.items()}


def display_percentile(metric: str, pct: Column, trust: Column) -> Column:
    """Shrunk to the median; turnovers are turned so that high is good."""
    pct = 100.0 - pct if metric == "tov_per36" else pct
    return clip(50.0 + trust * (pct - 50.0), 0.0, 100.0)


def scale_by_minutes(metric: str, pct: Column, mpg_pct: Column) -> Column:
    if metric not in P.MPG_SCALED_METRICS:
        return pct
    return pct * F.pow(clip(mpg_pct, 0.0, 100.0) / 100.0, F.lit(1.5))


def unscale_by_minutes(metric: str, pct: Column, mpg_pct: Column) -> Column:
    if metric not in P.MPG_SCALED_METRICS:
        return pct
    factor = clip(mpg_pct, 0.0, 100.0) / 100.0
    return F.when(factor == 0, pct).otherwise(F.least(pct / F.pow(factor, F.lit(1.5)), F.lit(100.0)))


# ---- display transforms -----------------------------------------------------
def distance_similarity(dist: Column) -> Column:
    return 100.0 / (1.0 + dist)


def cosine_display(cosine: Column, gamma: float = 5.5) -> Column:
    return 100.0 * F.pow(clip(cosine, 0.0, 1.0), F.lit(gamma))


def composite_display(score: Column) -> Column:
    return 78.0 * F.pow(clip(score / 1.45, 0.0, 1.0), F.lit(2.0))


def logistic_display(score: Column) -> Column:
    return clip(100.0 / (1.0 + F.exp(-score)), 0.0, 100.0)


def outlook(win_pct: Column, fit_delta: Column) -> dict[str, Column]:
    return {"projected_wins": F.bround(win_pct * 82.0, 0), "fit_delta_wins": fit_delta * 82.0}


def verdict(delta_wins: Column) -> Column:
    # fixed thresholds
    return (
        F.when(delta_wins >= 4.0, "clear upgrade")
        .when(delta_wins >= 1.5, "modest upgrade")
        .when(delta_wins > -0.75, "wash")
        .when(delta_wins > -3.0, "modest step back")
        .otherwise("clear downgrade")
    )


def metric_map(values: dict[str, Column], percentiles: dict[str, Column]) -> Column:
    """map<metric, struct<value, percentile>>; missing entries are zeros."""
    zero = F.lit(0.0)
    entries = []
    for k in P.METRICS:
        entries += [F.lit(k), F.struct(
            F.coalesce(values.get(k, zero), zero).alias("value"),
            F.coalesce(percentiles.get(k, zero), zero).alias("percentile"))]
    return F.create_map(*entries)


def complete_metric_map(metrics: Column) -> Column:
    """All 12 keys; absent ones are {0, 0}."""
    zero = F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("percentile"))
    keys = F.array(*map(F.lit, P.METRICS))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.try_element_at(metrics, k), zero)))
