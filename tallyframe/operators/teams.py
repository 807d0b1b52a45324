"""Team seasons: merging, normalization, style, badges, leaders, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import preset as P
from ..functions import rules, scores
from ..functions.clean import number
from .ranking import LIMIT, clean_value, pct_avg, with_ranks, with_zscores
from .upserts import first_per_key

TEAM_KEY = ["team_id", "season"]


def merge_team_sources(advanced: DataFrame, shooting: DataFrame, misc: DataFrame | None) -> DataFrame:
    """Advanced rows with shooting and, when it was landed, misc columns."""
    out = advanced.join(shooting, TEAM_KEY, "left")
    return out.withColumn("pts_paint", F.lit(None).cast("double")) if misc is None else out.join(misc, TEAM_KEY, "left")


def normalize_teams(teams: DataFrame) -> DataFrame:
    """z-scores within the season; a column without spread is only centered."""
    present = [f for f in P.TEAM_FEATURES if f in teams.columns]
    return with_zscores(teams, present, ["season"], "_z", flat="unit")


def style_vectors(teams: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Six 0..100 axes: rank within the season, oriented so that high is strong. Fewer than two values: 50."""
    axes = {a: clean_value(F.col(c)) * sign if c in teams.columns else F.lit(None).cast("double")
            for a, (c, sign) in P.STYLE_AXES.items()}
    df = teams.withColumns({f"_ax_{a}": c for a, c in axes.items()})
    formula = lambda lt, le, n: F.when(n >= 2, pct_avg(lt, le, n))
    out = with_ranks(df, {f"style_{a}": (f"_ax_{a}", formula) for a in axes}, ["season"], ["team_id"], limit, 50.0)
    return out.drop(*[f"_ax_{a}" for a in axes])


def team_z() -> dict[str, Column]:
    return {f: F.coalesce(F.col(f"{f}_z"), F.lit(0.0)) for f in P.TEAM_FEATURES}


def with_badges(normalized: DataFrame) -> DataFrame:
    return normalized.withColumn("badges", rules.badges(team_z()))


def badge_scores(normalized: DataFrame) -> DataFrame:
    """One row per team season and earned badge with its exemplar score."""
    rows = with_badges(normalized).select(
        "team_id", "team_name", "season", record().alias("record"), *[f"{f}_z" for f in P.TEAM_FEATURES],
        F.explode("badges").alias("badge"))
    return rows.withColumn("exemplar", rules.exemplar_score(F.col("badge"), team_z())).drop(*[f"{f}_z" for f in P.TEAM_FEATURES])


def badge_leaders(normalized: DataFrame) -> DataFrame:
    """Best and second-best earner per season and badge; every badge has a row in every season."""
    scored = badge_scores(normalized)
    w = Window.partitionBy("season", "badge").orderBy(F.col("exemplar").desc(), "team_id")
    top = scored.withColumn("place", F.row_number().over(w)).where("place <= 2")
    entry = lambda i, c: F.max(F.when(F.col("place") == i, F.col(c)))
    found = top.groupBy("season", "badge").agg(*[
        entry(i, c).alias(f"{tag}_{c}") for i, tag in ((1, "top"), (2, "runner_up")) for c in ("team_id", "record", "exemplar")])
    grid = normalized.select("season").distinct().select("season", F.explode(F.array(*map(F.lit, P.BADGES))).alias("badge"))
    out = grid.join(found, ["season", "badge"], "left")
    return out.withColumns({f"{t}_score": scores.logistic_display(F.col(f"{t}_exemplar")) for t in ("top", "runner_up")})


def record() -> Column:
    return F.concat_ws("-", F.col("w").cast("bigint").cast("string"), F.col("l").cast("bigint").cast("string"))


# ---- leaders --------------------------------------------------------------------
VOLUME_STATS = ["pts", "ast", "reb", "stl", "blk"]
# fixed thresholds: games, minutes per game, three-point attempts per game
ACCURACY_TIERS = [(8, 12.0, 3.0), (5, 10.0, 2.0), (3, 8.0, 1.5)]


def accuracy_tier(gp: Column, mpg: Column, fg3a: Column, pct: Column) -> Column:
    chain = None
    for i, (g, m, a) in enumerate(ACCURACY_TIERS):
        cond = (gp >= g) & (mpg >= m) & (fg3a >= a) & pct.isNotNull()
        chain = F.when(cond, i) if chain is None else chain.when(cond, i)
    return chain.when(pct.isNotNull() & (fg3a >= 1.0), 3).when(pct.isNotNull(), 4)


def keep_best_tier(df: DataFrame, tier: str, keys: list[str]) -> DataFrame:
    """Rows of the first tier that has any row in the group (partial minimum, then a join)."""
    best = df.groupBy(*keys).agg(F.min(tier).alias("_best"))
    return df.join(best, keys).where(F.col(tier) == F.col("_best")).drop("_best")


def stat_leaders(roster: DataFrame, keys=("team", "season")) -> DataFrame:
    """Per-game leaders of five volume stats and of tiered three-point accuracy; ties go to the smaller id.
    roster: per-game gp, min (per game), fg3a, fg3_pct and the volume stats."""
    keys = list(keys)
    volume = [F.max_by("player_id", F.struct(number(F.col(s)).alias("v"), (-F.col("player_id")).alias("i"))).alias(f"{s}_leader")
              for s in VOLUME_STATS] + [F.max(number(F.col(s))).alias(f"{s}_value") for s in VOLUME_STATS]
    pct = number(F.col("fg3_pct"), None)
    tiered = roster.withColumns({"_pct": pct, "_tier": accuracy_tier(
        number(F.col("gp")), number(F.col("min")), number(F.col("fg3a")), pct)}).where("_tier is not null")
    accurate = keep_best_tier(tiered, "_tier", keys).groupBy(*keys).agg(
        F.max_by("player_id", F.struct("_pct", (-F.col("player_id")).alias("i"))).alias("fg3_pct_leader"),
        F.max("_pct").alias("fg3_pct_value"), F.min("_tier").alias("fg3_pct_tier"))
    return roster.groupBy(*keys).agg(*volume).join(accurate, keys, "left")


def per_game(roster: DataFrame) -> DataFrame:
    cols = ["min", "pts", "ast", "reb", "stl", "blk", "fg3a", "fga"]
    return roster.withColumns({c: F.coalesce(F.try_divide(F.col(c), F.col("gp")), F.lit(0.0)) for c in cols})


# ---- profiles, catalogs ------------------------------------------------------------
def team_profiles(teams: DataFrame, normalized: DataFrame, similar: DataFrame, leaders: DataFrame) -> DataFrame:
    """Record, style, badges, similar seasons and leaders per team season. Team seasons without leaders are left out."""
    from .pairs import team_key

    base = first_per_key(teams, TEAM_KEY, [F.col("team_name")])
    styled = style_vectors(base).select(*TEAM_KEY, *[f"style_{a}" for a in P.STYLE_AXES])
    earned = with_badges(first_per_key(normalized, TEAM_KEY, [F.col("team_name")])).select(*TEAM_KEY, "badges")
    listed = similar.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "similar_key", "similarity_pct"))).alias("similar"))
    out = base.select(*TEAM_KEY, "team_name", record().alias("record"), F.col("w_pct").alias("win_pct"), team_key().alias("key"))
    return (out.join(styled, TEAM_KEY).join(earned, TEAM_KEY).join(listed, "key", "left")
            .join(leaders, TEAM_KEY))


def season_ready(teams: DataFrame, min_teams: int = 30, min_games: int = 10) -> DataFrame:
    """Is a season far enough along: enough teams, and every team past the minimum of games."""
    out = teams.groupBy("season").agg(F.count(F.lit(1)).alias("teams"), F.min(number(F.col("gp").cast("string"))).alias("lowest"))
    return out.withColumns({
        "lowest": F.when(F.col("teams") >= min_teams, F.col("lowest")),
        "ready": (F.col("teams") >= min_teams) & (F.col("lowest") >= min_games)})


def season_index(teams: DataFrame) -> DataFrame:
    return teams.groupBy("team_id").agg(F.sort_array(F.collect_set("season")).alias("seasons"))


def available_classes(records: DataFrame) -> DataFrame:
    """Classes on record, and the upcoming one after the newest."""
    return records.agg(F.sort_array(F.collect_set("class_year")).alias("classes"), (F.max("class_year") + 1).alias("next_class"))


def with_abbreviations(similar: DataFrame, metadata: DataFrame) -> DataFrame:
    """Team metadata on similarity rows; the metadata table has one row per team."""

    meta = metadata.select(F.col("team_id").alias("_t"), "abbreviation", F.col("team_name").alias("similar_name"))
    out = similar.withColumn("_t", F.split("similar_key", ":")[0].cast("int"))
    return out.join(meta, "_t", "left").withColumn(
        "abbreviation", F.coalesce("abbreviation", F.lit(""))).drop("_t")
