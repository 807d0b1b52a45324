"""Season rows to scores and careers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import preset as P
from ..functions import rules, scores
from ..functions.clean import draft_value, height_bucket, height_inches, number, season_start, weight_pounds
from ..session import cut_lineage
from .attach import attach_row, keys_repeat
from .ranking import LIMIT, pct_avg, pct_le, rank_in_reference, with_ordinal, with_percentiles, with_ranks, with_zscores

SEASON_KEY = ["player_id", "season"]


def normalize_seasons(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """z-scores and average-rank percentiles within the season, z-scores within season and position."""
    ranked = with_percentiles(df, P.METRICS, ["season"], SEASON_KEY, limit=limit)
    source = None if keys_repeat(df, SEASON_KEY) else df  # ranking leaves one row a key
    out = with_zscores(ranked, P.METRICS, ["season"], "_z", source=source)
    return with_zscores(out, P.METRICS, ["season", "position_group"], "_pos_z", source=source)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c.cast("string")) != "", c)


def career_weight() -> Column:
    return F.greatest(number(F.col("min")), number(F.col("gp")) * 12.0)


def roll_up(df: DataFrame) -> DataFrame:
    """One row per player: weighted means of metrics and z-scores, totals, spans, modes, team list."""
    df = df.withColumn("_w", career_weight())
    weighted = []
    for m in [*[f"{x}_z" for x in P.METRICS], *P.METRICS]:
        x = number(F.col(m))
        mean = F.try_divide(F.sum(F.col("_w") * x), F.when(F.sum("_w") > 0, F.sum("_w")))
        weighted.append(F.coalesce(mean, F.avg(x)).alias(m))

    def usual(*cols: str) -> Column:
        return F.coalesce(*[F.mode(blank_to_null(F.col(c)), True) for c in cols])

    stints = F.sort_array(F.collect_set(F.when(
        F.trim("team") != "", F.struct(F.col("season"), F.trim("team").alias("team")))))
    out = df.groupBy("player_id").agg(
        F.max_by("player_name", "season").alias("player_name"),
        F.sum(number(F.col("gp"))).cast("bigint").alias("career_games"),
        F.sum(number(F.col("min"))).alias("career_minutes"),
        F.min("season").alias("first_season"), F.max("season").alias("last_season"),
        usual("position", "position_group").alias("primary_position"),
        usual("position_group").alias("position_group"),
        usual("height").alias("height"), draft_value(usual("weight")).alias("weight"),
        draft_value(usual("draft_year")).alias("draft_year"),
        draft_value(usual("draft_number")).alias("draft_position"),
        stints.alias("_stints"), *weighted)
    first_of_run = F.filter("_stints", lambda x, i: (i == 0) | (F.get("_stints", i - 1)["team"] != x["team"]))
    return out.withColumns({
        "career_teams": F.transform(first_of_run, lambda x: x["team"]),
        "career_span": F.concat_ws(" to ", "first_season", "last_season"),
        "last_season_start": season_start(F.col("last_season")),
    }).drop("_stints")


def career_percentiles(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Global percentiles, and percentiles within the height bucket (turnovers reversed)."""
    df = cut_lineage(with_percentiles(df, P.METRICS, [], ["player_id"], "_global_pctile", limit=limit))  # read several times below
    df = df.withColumns({"height_bucket": height_bucket(height_inches(F.col("height"))), "_neg_tov": -F.col("tov_per36")})
    outputs = {f"{m}_career_pctile": ("_neg_tov" if m == "tov_per36" else m, pct_avg) for m in P.METRICS}
    return with_ranks(df, outputs, ["height_bucket"], ["player_id"], limit, 50.0).drop("_neg_tov")


def add_labels(df: DataFrame) -> DataFrame:
    z = rules.zcols()
    return df.withColumns({"archetypes": rules.archetypes(z), "role": rules.player_role(z)})


def keep_players(df: DataFrame, current_season_start: int, window: int = 3, min_games: int = 82) -> DataFrame:
    """Recent players, or players with enough games."""
    recent = F.col("last_season_start") >= current_season_start - window + 1
    return df.where(recent | (F.col("career_games") >= min_games))


def qualified(games: Column, mpg: Column, minutes: float = 300.0) -> Column:
    return games * mpg >= minutes


def career_features(seasons: DataFrame, current_season_start: int | None = None) -> DataFrame:
    """Normalized seasons to career rows. Percentiles come before the filter, as its population is everyone."""
    out = career_percentiles(roll_up(seasons))
    if current_season_start is not None:
        out = keep_players(out, current_season_start)
    return add_labels(out)


def pct_cols(suffix: str, metrics=P.METRICS) -> dict[str, Column]:
    return {m: F.col(f"{m}{suffix}") for m in metrics}


def _or_median(c: Column) -> Column:
    """Null and 0 read as the median, as in the per-season score."""
    return F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(50.0))


def season_scores(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per-season impact value and its ranked, workload-adjusted form."""
    pct = {m: _or_median(c) for m, c in pct_cols("_pctile").items()}
    df = df.withColumn("pfv", scores.impact_score(pct, scores.credibility(F.col("min"), P.SEASON_CREDIBILITY_MINUTES)))
    df = df.withColumn("adjusted", F.col("pfv") * scores.workload(F.col("mpg_pctile"), F.col("min")))
    df = with_ordinal(df, "adjusted", ["season"], ["player_id"], limit=limit)
    return df.withColumn("apfv", scores.rank_curve(F.col("ord"), F.col("ord_n"))).drop("ord", "ord_n", "adjusted")


def career_score(scored: DataFrame) -> DataFrame:
    """Minutes-weighted mean of season scores; seasons without minutes do not count."""
    played = scored.where(F.col("min") > 0)
    return played.groupBy("player_id").agg((F.sum(F.col("apfv") * F.col("min")) / F.sum("min")).alias("career_apfv"))


def career_impact(career: DataFrame) -> DataFrame:
    """Impact of the career line on global percentiles."""
    pct = pct_cols("_global_pctile")
    return career.withColumn("pfv", scores.impact_score(pct, scores.credibility(F.col("career_minutes"))))


def pool_impact(career: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Career line ranked over the whole pool: what careers without season scores fall back to."""
    df = career_impact(career)
    df = df.withColumn("adjusted", F.col("pfv") * scores.workload(F.col("mpg_global_pctile"), F.col("career_minutes")))
    df = with_ordinal(df, "adjusted", [], ["player_id"], limit=limit)
    return df.withColumn("apfv", scores.rank_curve(F.col("ord"), F.col("ord_n"))).drop("ord", "ord_n")


def curve_in_pool(df: DataFrame, value: str, group: list[str], key: list[str], out: str,
                  exponent: float = P.LEGACY_CURVE, anchor: float | None = None, limit: int = LIMIT) -> DataFrame:
    """Rank-curve score of a value within its pool: the share at or below it, curved."""
    df = with_ranks(df, {"_share": (value, lambda lt, le, n: le / n)}, group, key, limit)
    return df.withColumn(out, scores.anchored_curve(F.col("_share"), F.col(value), exponent, anchor)).drop("_share")


def curve_against_pool(values: DataFrame, pool: DataFrame, value: str, bucket: str, key: str, out: str = "apfv") -> DataFrame:
    """Score of rows against another table's pool of the same bucket. A value the pool does not
    hold counts as one more member."""
    at = pool.groupBy(bucket, value).agg(F.count(F.lit(1)).alias("c"))
    probe = values.withColumn("_vid", F.col(key)).withColumn("value", F.col(value))
    counts = lambda lt, le, n: le / n
    share = rank_in_reference(probe, pool.withColumn("value", F.col(value)), [bucket], "value", counts, 0.0, "_share")
    sizes = pool.groupBy(bucket).agg(F.count(value).alias("_n"))
    joined = share.join(sizes, bucket, "left").join(at, [bucket, value], "left")
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("double")
    inside = F.col("c").isNotNull()
    full = F.when(inside, F.col("_share")).otherwise((F.col("_share") * n + 1) / (n + 1))
    return joined.withColumn(out, scores.anchored_curve(full, F.col(value))).drop("_share", "_n", "c", "_vid", "value")


def caliber(career: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Polygon shape times workload, ranked within the height bucket."""
    pct = {m: _or_median(c) for m, c in pct_cols("_global_pctile", [*P.SKILL_AXES, "mpg"]).items()}
    df = career.withColumns({
        "polygon": scores.polygon_workload(pct), "height_bucket": height_bucket(height_inches(F.col("height")))})
    return curve_in_pool(df, "polygon", ["height_bucket"], ["player_id"], "caliber", limit=limit)


def fill_sizes(df: DataFrame, height_default: float = 78.0, weight_default: float = 215.0) -> DataFrame:
    """Numeric height and weight; zeros take the mean of the positive ones."""
    df = df.withColumns({"_h": height_inches(F.col("height")), "_p": weight_pounds(F.col("weight"), weight_default)})
    means = df.agg(F.avg(F.when(F.col("_h") > 0, F.col("_h"))).alias("_hm"),
                   F.avg(F.when(F.col("_p") > 0, F.col("_p"))).alias("_pm"))
    df = attach_row(df, means)
    return df.withColumns({
        "height_inches": F.when(F.col("_h") == 0, F.coalesce("_hm", F.lit(height_default))).otherwise(F.col("_h")),
        "weight_lbs": F.when(F.col("_p") == 0, F.coalesce("_pm", F.lit(weight_default))).otherwise(F.col("_p")),
    }).drop("_h", "_p", "_hm", "_pm")


# ---- prospects -------------------------------------------------------------------
def prospect_scores(df: DataFrame, key: str = "prospect_id", limit: int = LIMIT) -> DataFrame:
    """Percentiles over all classes, impact, its damped form and the anchored score per height bucket."""
    df = with_percentiles(df, P.PROSPECT_METRICS, [], [key], "_pct", pct_le, limit, 0.0)
    pct = {m: F.col(f"{m}_pct") for m in P.PROSPECT_METRICS}
    df = df.withColumn("pfv", scores.impact_score(pct))
    df = df.withColumns({
        "adjusted": F.col("pfv") * scores.prospect_damper(F.col("mpg"), F.col("gp"), F.col("ts_pct")),
        "height_bucket": height_bucket(height_inches(F.col("height")))})
    return curve_in_pool(df, "adjusted", ["height_bucket"], [key], "apfv", P.PROSPECT_CURVE, P.PROSPECT_ANCHOR, limit)


def prospect_quality(df: DataFrame, group: list[str], key: str = "prospect_id", bucket: bool = True,
                     out: str = "quality", limit: int = LIMIT) -> DataFrame:
    """Polygon shape on percentiles within the class, damped, then ranked."""
    names = list(dict.fromkeys([*P.SKILL_AXES, "mpg"]))
    df = with_percentiles(df, names, group, [key], "_qpct", pct_le, limit, 0.0)
    pct = {m: F.col(f"{m}_qpct") for m in names}
    df = df.withColumns({
        "_adj": scores.polygon_score(pct) * scores.prospect_damper(F.col("mpg"), F.col("gp"), F.col("ts_pct")),
        "_bucket": height_bucket(height_inches(F.col("height")))})
    df = curve_in_pool(df, "_adj", [*group, "_bucket"] if bucket else group, [key], out, limit=limit)
    return df.drop("_adj", "_bucket", *[f"{m}_qpct" for m in names])


def pool_quality(df: DataFrame, bucket: bool = True, out: str = "quality", limit: int = LIMIT) -> DataFrame:
    pct = {m: F.coalesce(F.col(f"{m}_global_pctile"), F.lit(0.0)) for m in [*P.SKILL_AXES, "mpg"]}
    df = df.withColumns({"_adj": scores.polygon_workload(pct), "_bucket": height_bucket(height_inches(F.col("height")))})
    return curve_in_pool(df, "_adj", ["_bucket"] if bucket else [], ["player_id"], out, limit=limit).drop("_adj", "_bucket")


def add_prospect_roles(df: DataFrame, group: list[str]) -> DataFrame:
    names = [m for m in P.PROSPECT_METRICS if m != "mpg"]
    df = with_zscores(df, names, group, "_cz", sample=True, flat="unit")
    z = {m: F.col(f"{m}_cz") for m in names}
    return df.withColumn("role", rules.prospect_role(z)).drop(*[f"{m}_cz" for m in names])


def class_box_percentiles(df: DataFrame, columns: list[str], group: list[str], key: str, limit: int = LIMIT) -> DataFrame:
    return with_percentiles(df, columns, group, [key], "_class_pct", pct_le, limit, 0.0)


def write_back_scores(records: DataFrame, fresh: DataFrame, key: str = "prospect_id") -> DataFrame:
    """Recomputed scores replace stored ones; records without a new score keep theirs."""
    new = fresh.select(key, F.col("pfv").alias("_pfv"), F.col("apfv").alias("_apfv"))
    return records.join(new, key, "left").withColumns({
        "pfv": F.coalesce("_pfv", "pfv"), "apfv": F.coalesce("_apfv", "apfv")}).drop("_pfv", "_apfv")
