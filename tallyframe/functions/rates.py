"""Per-unit and share rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..preset import PROJECTION_INPUT_RANGES
from ..session import cut_lineage
from .clean import clip, height_inches, number, ratio


def per36(value: Column, minutes: Column, keep_raw: bool = True) -> Column:
    """value / minutes * 36. Without minutes: the raw value, or 0 when keep_raw is off."""
    rate = F.try_divide(value, minutes) * 36.0
    return F.coalesce(rate, value if keep_raw else F.lit(0.0))


def true_shooting(pts: Column, fga: Column, fta: Column) -> Column:
    return ratio(pts, 2.0 * (fga + 0.44 * fta))


def effective_fg(fgm: Column, fg3m: Column, fga: Column) -> Column:
    return ratio(fgm + 0.5 * fg3m, fga)


def assist_share(ast: Column, fgm: Column, minutes: Column, team_fgm: Column, team_min: Column) -> Column:
    """Share of team mates' makes a player assisted while playing, within 0..1."""
    mates = F.try_divide(minutes, team_min / 5.0) * team_fgm - fgm
    share = F.try_divide(ast, F.when(mates > 0, mates))
    return clip(F.coalesce(share, F.lit(0.0)), 0.0, 1.0)


def with_team_totals(df: DataFrame, keys=("season", "team")) -> DataFrame:
    """Team FGM and MIN on each row. Aggregated first (partial sums), then joined: a big team
    is never one window partition."""
    keys = list(keys)
    totals = cut_lineage(df.groupBy(*keys).agg(F.sum("fgm").alias("team_fgm"), F.sum("min").alias("team_min")))
    return df.join(totals, keys, "left")


def add_rates(df: DataFrame) -> DataFrame:
    """The 12 metrics from box-score totals."""
    c = F.col
    df = with_team_totals(df)
    out = {f"{k}_per36": per36(c(k), c("min")) for k in ("pts", "ast", "reb", "stl", "blk", "tov")}
    out.update(
        fg3a_rate=ratio(c("fg3a"), c("fga")),
        fta_rate=ratio(c("fta"), c("fga")),
        ts_pct=true_shooting(c("pts"), c("fga"), c("fta")),
        efg_pct=effective_fg(c("fgm"), c("fg3m"), c("fga")),
        ast_pct=assist_share(c("ast"), c("fgm"), c("min"), c("team_fgm"), c("team_min")),
        mpg=ratio(c("min"), c("gp")),
    )
    return df.withColumns(out).drop("team_fgm", "team_min")


def zone_frequencies(shots: DataFrame) -> DataFrame:
    """Share of shots per zone and player, by case-insensitive patterns."""
    basic, area, dist = (F.lower(F.coalesce(F.col(x), F.lit(""))) for x in
                         ("shot_zone_basic", "shot_zone_area", "shot_zone_range"))
    # fixed patterns
    rim = basic.rlike("restricted area")
    mid = basic.rlike("mid-range|in the paint")
    corner = (basic.rlike("above the break 3|right corner 3|left corner 3|corner")
              & area.rlike("right side|left side") & dist.rlike(r"24\+|3pt"))
    n = F.count(F.lit(1))
    return shots.groupBy("player_id").agg(
        (F.count_if(rim) / n).alias("rim_freq"),
        (F.count_if(mid) / n).alias("midrange_freq"),
        (F.count_if(corner) / n).alias("corner3_freq"),
    )


def team_rates(df: DataFrame) -> DataFrame:
    """Free-throw rate, and paint attempts filled from paint points."""
    return df.withColumns({
        "paint_fga": F.coalesce(number(F.col("paint_fga"), None), number(F.col("pts_paint"), None)),
        "fta_rate": F.try_divide(number(F.col("fta"), None), number(F.col("fga"), None)),
    })


def prospect_rates(df: DataFrame) -> DataFrame:
    """Per-game prospect lines (gp, mpg, ppg, fgm, fga, fg3m, fg3a, ftm, fta, rpg, apg, spg, bpg)
    to the prospect metrics; anything unreadable counts as 0."""
    stats = ["gp", "mpg", "ppg", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "rpg", "apg", "spg", "bpg"]
    df = df.withColumns({s: number(F.col(s)) for s in stats})
    c = F.col
    return df.withColumns({
        "pts_per36": per36(c("ppg"), c("mpg"), False),
        "ast_per36": per36(c("apg"), c("mpg"), False),
        "reb_per36": per36(c("rpg"), c("mpg"), False),
        "stl_per36": per36(c("spg"), c("mpg"), False),
        "blk_per36": per36(c("bpg"), c("mpg"), False),
        "fg3a_rate": ratio(c("fg3a"), c("fga")),
        "fta_rate": ratio(c("fta"), c("fga")),
        "ts_pct": true_shooting(c("ppg"), c("fga"), c("fta")),
        "efg_pct": effective_fg(c("fgm"), c("fg3m"), c("fga")),
        "ast_pct": ratio(c("apg"), c("fgm")),
    })


def add_load_axes(df: DataFrame) -> DataFrame:
    """Engineered axes used by the cross-pool comparison."""
    c = F.col
    share = clip(c("ast_pct"), 0.0, 1.0)
    return df.withColumns({
        "stocks": c("stl_per36") + c("blk_per36"),
        "scoring_load": c("pts_per36") * (1.0 - share),
        "playmake_load": c("ast_per36") + 0.5 * share,
        "perimeter_skill": c("fg3a_rate") * c("ts_pct"),
        "interior_load": c("reb_per36") + 2.0 * c("blk_per36"),
    })


def projection_inputs(df: DataFrame) -> DataFrame:
    """Clipped feature columns x_<name> for the projection model."""
    raw = {name: F.coalesce(F.col(name), F.lit(0.0)) for name in PROJECTION_INPUT_RANGES
           if name not in ("ast_pct_college", "fg3_pct_college", "height_in", "weight")}
    raw["ast_pct_college"] = F.when(F.col("fgm") > 0, F.col("apg") / F.col("fgm")).otherwise(0.0)
    raw["fg3_pct_college"] = number(F.col("fg3_pct"))
    raw["height_in"] = height_inches(F.col("height"), 78.0)
    weight = number(F.col("weight").cast("string"))
    raw["weight"] = F.when(weight == 0, 215.0).otherwise(weight)
    return df.withColumns({f"x_{k}": clip(raw[k], lo, hi) for k, (lo, hi) in PROJECTION_INPUT_RANGES.items()})
