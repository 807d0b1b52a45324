"""Player read queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import preset as P
from ..functions import rules, scores
from ..functions.clean import distinct_labels, height_bucket, height_inches, normalize_season, weight_pounds
from ..operators import career as C
from ..operators.pairs import similar_players
from ..session import cut_lineage

TOP_ROWS = 10_000  # pages ending above this place are found without sorting everything
# the sort keys of the leaderboard
BOX_KEYS = ["pts_per36", "ast_per36", "reb_per36", "stl_per36", "blk_per36", "tov_per36", "ts_pct", "efg_pct",
            "fg3a_rate", "fta_rate", "mpg"]


def page_of(df: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    """One page of a sorted table with its 1-based place; a page past the end is the last page. Near the top only the rows
    up to the page end are kept while sorting, further down all rows are sorted in ranges."""
    start = (max(page, 1) - 1) * page_size
    if start:
        df = cut_lineage(df)
        start = min(start, max(0, (df.count() - 1) // page_size * page_size))
    if start + page_size > TOP_ROWS:
        rows = range_places(df, order)
    else:
        rows = df.orderBy(*order).limit(start + page_size)
        rows = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # at most TOP_ROWS rows
    return rows.where((F.col("place") > start) & (F.col("place") <= start + page_size))


def range_places(df: DataFrame, order: list[Column]) -> DataFrame:
    """The 1-based place of every row: range-sorted partitions are written once, and each partition's first place is the
    count of rows before it (one row for each partition)."""
    ordered = cut_lineage(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    return (ordered.join(F.broadcast(sizes), "_part")
            .withColumn("place", (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int")).drop("_part", "_at", "_n", "_first", "_before"))


def career_leaderboard(features: DataFrame, page: int = 1, page_size: int = 25, min_minutes: float = 300.0) -> DataFrame:
    """Career score from season scores, qualified players only, best first."""
    scored = C.season_scores(features).where(F.col("min") > 0)
    board = scored.groupBy("player_id").agg(
        F.max_by("player_name", "season").alias("player_name"), F.sum("gp").cast("bigint").alias("games"),
        F.sum("min").alias("minutes"), (F.sum(F.col("apfv") * F.col("min")) / F.sum("min")).alias("career_apfv"),
        F.max("apfv").alias("best_season")).where(F.col("minutes") >= min_minutes)
    out = page_of(board, [F.col("career_apfv").desc(), F.col("player_id")], page, page_size)
    return out.select("place", "player_id", "player_name", "games", "minutes", "career_apfv", "best_season")


def sort_value(key: str) -> Column:
    """A leaderboard key: a skill rating, box_<metric>, height, weight or the score itself."""
    if key in P.SKILL_AXES:
        return F.col(f"{key}_rating")
    if key.startswith("box_") and key[4:] in BOX_KEYS:
        return F.col(key[4:])
    if key == "height":
        return height_inches(F.col("height"))
    if key == "weight":
        return weight_pounds(F.col("weight"), 0.0)
    return F.coalesce(F.col("apfv"), F.lit(-1.0))


def leader_items(scored: DataFrame, pct_suffix: str) -> DataFrame:
    """Scored rows with the six skill ratings."""
    pct = {a: F.col(f"{a}{pct_suffix}") for a in P.SKILL_AXES}
    rated = scores.skill_ratings(pct, F.col("apfv"))
    return scored.withColumns({f"{a}_rating": c for a, c in rated.items()})


def leaders(items: DataFrame, sort: str = "apfv", descending: bool = True, role: str | None = None, page: int = 1,
            page_size: int = 25, games: str = "career_games") -> DataFrame:
    """A page of qualified rows by any of the sort keys, then by score, then by id."""
    rows = items.where(C.qualified(F.col(games), F.col("mpg")))
    if role:
        rows = rows.where(F.col("role") == role)
    rows = rows.withColumns({"sort_value": sort_value(sort), "_apfv": F.coalesce(F.col("apfv"), F.lit(-1.0))})
    by = [c.desc() if descending else c.asc() for c in (F.col("sort_value"), F.col("_apfv"))]
    return page_of(rows, [*by, F.col("player_id")], page, page_size).drop("_apfv")


def page_totals(items: DataFrame, page_size: int = 25, games: str = "career_games") -> DataFrame:
    """Totals and roles that go with a page."""
    rows = items.where(C.qualified(F.col(games), F.col("mpg")))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / page_size)).alias("total_pages"),
                    F.sort_array(F.collect_set("role")).alias("roles"))


def players_with_archetype(careers: DataFrame, archetype: str) -> DataFrame:
    return careers.where(rules.has_archetype(F.col("archetypes"), archetype))


def player_seasons(seasons: DataFrame) -> DataFrame:
    valid = seasons.where(normalize_season(F.col("season")).isNotNull())
    return valid.groupBy("player_id").agg(F.sort_array(F.collect_set("season"), asc=False).alias("seasons"))


def shown_metrics(value_suffix: str, pct_suffix: str, trust: Column) -> Column:
    values = {m: F.col(f"{m}{value_suffix}") for m in P.METRICS}
    pct = {m: scores.display_percentile(m, F.coalesce(F.nullif(F.col(f"{m}{pct_suffix}"), F.lit(0.0)), F.lit(50.0)), trust)
           for m in P.METRICS}
    return scores.metric_map(values, pct)


def player_profiles(features: DataFrame, careers: DataFrame) -> DataFrame:
    """Career profiles: score from the seasons, the pool rank where there is none."""
    seasonal = C.career_score(C.season_scores(features))
    pooled = C.pool_impact(careers).withColumnRenamed("apfv", "pool_apfv")
    trust = scores.credibility(F.col("career_minutes"))
    out = pooled.join(seasonal, "player_id", "left").withColumns({
        "apfv": F.coalesce("career_apfv", "pool_apfv"), "career_teams": distinct_labels(F.col("career_teams")),
        "playstyle_metrics": scores.complete_metric_map(shown_metrics("", "_global_pctile", trust))})
    return leader_items(out, "_global_pctile")


def player_profile(features: DataFrame, careers: DataFrame, player_id: int) -> DataFrame:
    """One player's profile: scored against everyone, then filtered."""
    return player_profiles(features, careers).where(F.col("player_id") == player_id)


def season_bundle(features: DataFrame, careers: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Every season's player payloads: labels, scores and neighbours within the season. Career bio, when given,
    overrides the season row's."""
    df = C.season_scores(C.add_labels(features)).withColumns({
        "first_season": F.col("season"), "height_bucket": height_bucket(height_inches(F.col("height")))})
    pct = {m: F.coalesce(F.nullif(F.col(f"{m}_pctile"), F.lit(0.0)), F.lit(50.0)) for m in [*P.SKILL_AXES, "mpg"]}
    df = df.withColumn("polygon", scores.polygon_workload(pct))
    df = C.curve_in_pool(df, "polygon", ["season", "height_bucket"], ["player_id"], "caliber")
    df = df.withColumns({"height_inches": F.greatest(height_inches(F.col("height")), F.lit(0.0)),
                         "weight_lbs": weight_pounds(F.col("weight"), 215.0)})
    means = df.groupBy("season").agg(F.avg(F.when(F.col("height_inches") > 0, F.col("height_inches"))).alias("_hm"),
                                     F.avg(F.when(F.col("weight_lbs") > 0, F.col("weight_lbs"))).alias("_wm"))
    df = df.join(means, "season").withColumns({
        "height_inches": F.when(F.col("height_inches") == 0, F.coalesce("_hm", F.lit(78.0))).otherwise(F.col("height_inches")),
        "weight_lbs": F.when(F.col("weight_lbs") == 0, F.coalesce("_wm", F.lit(215.0))).otherwise(F.col("weight_lbs"))}).drop("_hm", "_wm")
    df = cut_lineage(df)
    near = similar_players(df, "_pctile", k, within="season")
    lists = near.groupBy("player_id", "season").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "similar_id"))), lambda x: x["similar_id"]).alias("similar"))
    trust = scores.credibility(F.col("min"), P.SEASON_CREDIBILITY_MINUTES)
    out = df.join(lists, ["player_id", "season"], "left").withColumn("playstyle_metrics", shown_metrics("", "_pctile", trust))
    if careers is not None:
        bio = ["player_name", "height", "weight", "draft_year"]
        over = careers.select("player_id", *[F.col(b).alias(f"_c_{b}") for b in bio])
        out = out.join(over, "player_id", "left").withColumns({b: F.coalesce(f"_c_{b}", b) for b in bio}).drop(*[f"_c_{b}" for b in bio])
    return out
