"""Five-member units: picking starters, collective stats, season baselines, model features, composition."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import preset as P
from ..functions import rules
from ..functions.clean import clip, label_parts, number
from ..session import cut_lineage
from .ranking import LIMIT, pct_mid, rank_in_reference
from .teams import keep_best_tier
from .upserts import first_per_key

UNIT = ["team", "season"]


# ---- names to roster rows -----------------------------------------------------------
def match_labels(labels: DataFrame, roster: DataFrame) -> DataFrame:
    """labels: team, season, pos, label (a few for each team season). Adds player_id by the first tier that fits: the exact name when unique,
    initial and last name (smallest id), a name ending when unique. Each roster row meets the labels of its team season and goes on only with those it fits."""
    name, words = F.lower("player_name"), F.split(F.col("player_name"), r"\s+")
    text = F.trim("label")
    pattern = r"^([A-Za-z])\.?\s+(.+)$"
    keys = {"k1": F.lower(text), "k2a": F.lower(F.regexp_extract(text, pattern, 1)), "k2b": F.lower(F.regexp_extract(text, pattern, 2)),
            "k3": F.lower(F.element_at(F.split(text, r"\s+"), -1))}
    asked = labels.withColumns(keys)
    wanted = cut_lineage(asked.groupBy(*UNIT).agg(F.collect_set(F.struct(*keys)).alias("_asked")))
    first, last = F.lower(F.substring(words[0], 1, 1)), F.lower(F.element_at(words, -1))
    fits = lambda x: F.array(*[F.coalesce(c, F.lit(False)) for c in (
        name == x["k1"], (F.size(words) >= 2) & (first == x["k2a"]) & (last == x["k2b"]), (x["k3"] != "") & name.endswith(x["k3"]))])
    tried = F.transform("_asked", lambda x: F.struct(x.alias("of"), fits(x).alias("fits")))
    hits = roster.select(*UNIT, "player_id", "player_name").join(wanted, UNIT).select(
        *UNIT, "player_id", F.explode(F.filter(tried, lambda x: F.array_contains(x["fits"], True))).alias("x"))
    at = lambda i: F.get("x.fits", F.lit(i))
    least = lambda i: F.min(F.when(at(i), F.col("player_id")))
    alone = lambda i: F.when(F.count_if(at(i)) == 1, least(i))
    found = hits.groupBy(*UNIT, *[F.col(f"x.of.{k}").alias(k) for k in keys]).agg(F.coalesce(alone(0), least(1), alone(2)).alias("player_id"))
    return asked.join(found, [*UNIT, *keys], "left").drop(*keys)


def starting_lineups(groups: DataFrame, roster: DataFrame, min_unit_games: float = 10, min_player_games: float = 20,
                     min_minutes: float = 18.0) -> DataFrame:
    """The heaviest-minutes five of each team season, else its five biggest minutes. groups: team, season, group_name, gp, min
    (totals). roster: per-game rows. One row per starter with roles, source and, for found units, minutes per game."""
    usable = groups.withColumns({"gp": number(F.col("gp")), "min": number(F.col("min"), None)}).where("min is not null")
    usable = usable.withColumn("_tier", F.when(F.col("gp") >= min_unit_games, 0).otherwise(1))
    top = first_per_key(keep_best_tier(usable, "_tier", UNIT), UNIT, [F.col("min").desc(), F.col("group_name")])
    parts = label_parts(F.col("group_name"))
    top = top.where(F.size(parts) >= 5).withColumn("lineup_mpg", F.coalesce(F.try_divide("min", "gp"), F.lit(0.0)))
    # the few rows a unit has are stages: Spark sees their size and sends them to the roster, never the roster to them
    labels = cut_lineage(top.select(*UNIT, "lineup_mpg", F.posexplode(F.slice(parts, 1, 5)).alias("pos", "label")))
    matched = match_labels(labels, roster).where("player_id is not null")
    matched = cut_lineage(first_per_key(matched, [*UNIT, "player_id"], [F.col("pos")]))
    rows = matched.join(roster, [*UNIT, "player_id"])
    whole = rows.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("_n"), F.min("min").alias("_low")).where(
        (F.col("_n") == 5) & (F.col("_low") >= min_minutes)).select(*UNIT)
    found = rows.join(whole, UNIT).select(*UNIT, "player_id", "pos", "lineup_mpg", F.lit("lineup_minutes").alias("source"))

    w = Window.partitionBy(*UNIT).orderBy(F.col("min").desc(), "player_id")
    heavy = roster.where(F.col("gp") >= min_player_games).withColumn("_rn", F.row_number().over(w)).where("_rn <= 5")
    heavy = cut_lineage(heavy.select(*UNIT, "player_id", (F.col("_rn") - 1).alias("pos")))
    full = heavy.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("_n")).where("_n = 5").select(*UNIT)
    fallback = (heavy.join(full, UNIT).join(whole, UNIT, "left_anti")
                .select(*UNIT, "player_id", "pos", F.lit(None).cast("double").alias("lineup_mpg"), F.lit("minutes_fallback").alias("source")))
    chosen = cut_lineage(found.unionByName(fallback)).join(roster, [*UNIT, "player_id"])
    return with_scored_roles(chosen, UNIT)


def with_scored_roles(rows: DataFrame, unit: list[str]) -> DataFrame:
    """Score-based roles from stats normalized within the unit (five rows per window)."""
    w = Window.partitionBy(*unit)
    stats = {s: number(F.col(s)) for s in ("pts", "ast", "reb", "fg3a", "fg3_pct", "blk", "stl")}
    shots = F.when(number(F.col("fga"), 1.0) == 0, 1.0).otherwise(number(F.col("fga"), 1.0))
    stats["ast_fga"] = stats["ast"] / shots
    rows = rows.withColumns({f"_s_{k}": v for k, v in stats.items()})

    def scaled(k: str) -> Column:
        lo, hi = F.min(f"_s_{k}").over(w), F.max(f"_s_{k}").over(w)
        return F.when(hi <= lo, 0.5).otherwise(F.try_divide(F.col(f"_s_{k}") - lo, hi - lo))

    rows = rows.withColumns({f"_n_{k}": scaled(k) for k in stats})
    norm = {k: F.col(f"_n_{k}") for k in stats}
    rows = rows.withColumns({f"_r_{i}": c for i, c in enumerate(rules.role_scores(norm).values())})
    scored = {r: F.col(f"_r_{i}") for i, r in enumerate(P.ROLES)}
    out = rows.withColumn("roles", rules.scored_roles(scored, F.col("_s_ast"), F.col("_n_ast")))
    return out.drop(*[f"_{t}_{k}" for k in stats for t in "sn"], *[f"_r_{i}" for i in range(len(P.ROLES))])


# ---- unit rows ------------------------------------------------------------------------
def unit_rows(units: DataFrame, features: DataFrame, team_pace: DataFrame | None = None) -> DataFrame:
    """units: unit_id, season, player_id (and row_season when a member's season differs). Joined to season features; a member
    without a row for the asked season takes the latest season there is. Adds unit roles and the team's pace."""
    if "row_season" not in units.columns:
        units = units.withColumn("row_season", F.col("season"))
    have = features.select("player_id", F.col("season").alias("_have"))
    exact = units.join(have, (units.player_id == have.player_id) & (units.row_season == have._have), "left_semi")
    latest = features.groupBy("player_id").agg(F.max("season").alias("_latest"))
    rest = units.join(exact.select("unit_id", "player_id"), ["unit_id", "player_id"], "left_anti").join(latest, "player_id")
    asked = exact.unionByName(rest.withColumn("row_season", F.col("_latest")).drop("_latest"))
    return finish_rows(asked.withColumnRenamed("season", "unit_season").withColumnRenamed("row_season", "season")
                       .join(features, ["player_id", "season"]), team_pace)


def season_unit_rows(units: DataFrame, features: DataFrame, team_pace: DataFrame | None = None) -> DataFrame:
    """The plain form: members joined on (player, season)."""
    joined = units.join(features, ["player_id", "season"]).withColumn("unit_season", F.col("season"))
    return finish_rows(joined, team_pace)


def finish_rows(rows: DataFrame, team_pace: DataFrame | None) -> DataFrame:
    rows = rows.withColumn("unit_roles", rules.unit_roles(rules.zcols()))
    if team_pace is None:
        return rows.withColumn("team_pace", F.lit(98.0))
    return rows.join(team_pace, ["team", "season"], "left").withColumn("team_pace", F.coalesce("pace", F.lit(98.0))).drop("pace")


def complete_units(rows: DataFrame) -> DataFrame:
    whole = rows.groupBy("unit_id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 5").select("unit_id")
    return rows.join(whole, "unit_id")


def collective(rows: DataFrame) -> DataFrame:
    """Nine collective metrics per unit."""
    c = F.col
    rate = lambda x: F.sum(F.when(c("min") > 0, F.try_divide(x, c("min")) * 36.0).otherwise(0.0)) * P.UNIT_SCALE
    primary = F.get("unit_roles", F.lit(0))
    mpg = F.coalesce(F.try_divide(c("min"), F.when(c("gp") == 0, 1.0).otherwise(c("gp"))), F.lit(0.0))
    out = rows.groupBy("unit_id", "unit_season").agg(
        F.coalesce(F.try_divide(F.sum(c("team_pace") * mpg), F.sum(mpg)), F.lit(98.0)).alias("pace"),
        rate(c("fg3a")).alias("fg3a"), F.avg(rules.three_makes(c("fg3m"), c("min"))).alias("space"),
        rate(rules.paint_attempts(c("fga"), c("fg3a"), c("reb_per36_z"), c("blk_per36_z"))).alias("paint_fga"),
        F.sum(rules.defense_score(c("stl"), c("blk"), c("min"), primary)).alias("def_score"),
        rate(c("ast")).alias("ast"), rate(c("fgm")).alias("fgm"), rate(c("reb")).alias("reb"), rate(c("blk")).alias("blk"))
    return out.withColumns({
        "ast_pct": F.when(c("fgm") > 0, F.try_divide("ast", "fgm") * 100.0).otherwise(0.0),
        "paint_score": c("reb") + 4.0 * c("blk")})


def long_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.select("unit_id", F.col("unit_season").alias("season"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in P.BASELINE_METRICS])).alias("x")).select("unit_id", "season", "x.*")


def season_baselines(metrics: DataFrame, min_units: int = 5) -> DataFrame:
    """Distribution summary per season and metric. The values themselves stay rows (`long_metrics`), not arrays."""
    return long_metrics(metrics).groupBy("season", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max")).where(F.col("n") >= min_units)


def baseline_reference(metrics: DataFrame, stored: DataFrame | None = None, min_units: int = 5) -> DataFrame:
    """Reference values (season, metric, value): stored ones, and for seasons without any, those of the given units."""
    fresh = long_metrics(metrics)
    big = fresh.groupBy("season", "metric").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_units).drop("_n")
    fresh = fresh.join(big, ["season", "metric"]).select("season", "metric", "value")
    return fresh if stored is None else stored.select("season", "metric", "value").unionByName(
        fresh.join(stored.select("season").distinct(), "season", "left_anti"))


def style_percentiles(metrics: DataFrame, reference: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Mid-rank percentiles of a unit's metrics in its season, and the six style axes."""
    asked = long_metrics(metrics).withColumn("_vid", F.concat_ws(":", "unit_id", "metric"))
    ranked = rank_in_reference(asked, reference, ["season", "metric"], "value", pct_mid, 50.0, "pct", limit)
    wide = ranked.groupBy("unit_id", "season").agg(*[F.max(F.when(F.col("metric") == m, F.col("pct"))).alias(f"p_{m}") for m in P.BASELINE_METRICS])
    c = F.col
    return wide.select("unit_id", F.col("season").alias("unit_season"), c("p_pace").alias("s_pace"), c("p_space").alias("s_spacing"),
                       c("p_paint_fga").alias("s_paint"), c("p_def_score").alias("s_defense"),
                       (0.55 * c("p_ast") + 0.45 * c("p_ast_pct")).alias("s_playmaking"), c("p_reb").alias("s_rebounding"))


def blend_team_style(styles: DataFrame, rows: DataFrame, team_styles: DataFrame) -> DataFrame:
    """Unit percentiles mixed with the mean style of the members' own teams (50 where a team has none)."""
    own = rows.join(team_styles, ["team", "season"], "left").groupBy("unit_id").agg(*[
        F.avg(F.coalesce(F.col(f"style_{a}"), F.lit(50.0))).alias(f"_t_{a}") for a in P.STYLE_KEYS])
    # fixed shares of the unit's own value
    share = {"pace": 0.40, "paint": 0.40, "defense": 0.30, "playmaking": 0.60, "rebounding": 0.40}
    out = styles.join(own, "unit_id")
    mixed = {f"v_{a}": clip(s * F.col(f"s_{a}") + (1.0 - s) * F.col(f"_t_{a}"), 0.0, 100.0) for a, s in share.items()}
    return out.withColumns(mixed | {"v_three_point_volume": clip(F.col("s_spacing"), 0.0, 100.0)}).drop(*[f"_t_{a}" for a in P.STYLE_KEYS])


# ---- model features ----------------------------------------------------------------------
def _member_skills() -> dict[str, Column]:
    p = lambda m: F.coalesce(F.col(f"{m}_pctile"), F.lit(50.0))
    creation = 0.55 * p("ast_per36") + 0.45 * p("ast_pct")
    defense = F.greatest(p("stl_per36"), p("blk_per36"))
    talent = (0.25 * p("pts_per36") + 0.17 * creation + 0.13 * p("reb_per36") + 0.12 * defense + 0.18 * p("ts_pct") + 0.15 * p("mpg"))
    return {"pts": p("pts_per36"), "creation": creation, "shooting": p("fg3a_rate"), "rim": p("fta_rate"), "reb": p("reb_per36"),
            "stl": p("stl_per36"), "blk": p("blk_per36"), "eff": p("ts_pct"), "avail": p("mpg"), "defense": defense, "talent": talent}


def model_features(rows: DataFrame, styles: DataFrame) -> DataFrame:
    """The 39 unit features. Arrays hold the five members only."""
    c = F.col
    rows = rows.withColumns({f"k_{k}": v for k, v in _member_skills().items()})
    skills = ["pts", "creation", "shooting", "rim", "reb", "stl", "blk", "eff"]
    n = F.lit(5.0)
    has = lambda r: F.sum(F.array_contains("unit_roles", r).cast("int"))
    two_way = (c("k_pts") + c("k_eff") >= 120.0) & (c("k_defense") >= 60.0)
    g = rows.groupBy("unit_id").agg(
        *[F.sort_array(F.collect_list(f"k_{k}")).alias(k) for k in ("pts", "creation", "shooting", "reb", "stl", "blk", "eff", "avail", "talent")],
        F.avg("k_defense").alias("defense_mean"), (F.count_if(two_way) / n).alias("two_way_coverage"),
        F.collect_list(F.array(*[c(f"k_{s}") / 100.0 for s in skills])).alias("m"),
        *[has(r).alias(f"n_{i}") for i, r in enumerate(P.ROLES)],
        *[(F.count_if(c("position_group") == x) / n).alias(f"{t}_share") for x, t in (("G", "guard"), ("W", "wing"), ("B", "big"))])
    mean = lambda k: F.aggregate(k, F.lit(0.0), lambda a, x: a + x) / n
    top = lambda k, i: F.element_at(k, -i)
    counts = [c(f"n_{i}") for i in range(len(P.ROLES))]
    role_sum = rules.total(counts)
    kinds = rules.total([(x > 0).cast("int") for x in counts])
    share = [F.try_divide(x, role_sum) for x in counts]
    entropy = -rules.total([F.when(x > 0, s * F.log(s)).otherwise(0.0) for x, s in zip(counts, share)]) / F.log(F.lit(7.0))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    member = lambda i: F.get("m", F.lit(i))
    cosines, gaps = [], []
    for i, j in combinations(range(5), 2):
        norm = F.sqrt(dot(member(i), member(i))) * F.sqrt(dot(member(j), member(j)))
        cosines.append(F.coalesce(F.try_divide(dot(member(i), member(j)), norm), F.lit(0.0)))
        gaps.append(F.sqrt(F.aggregate(F.zip_with(member(i), member(j), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)) / (8.0 ** 0.5))
    s = {k: c(f"s_{k}") / 100.0 for k in ("pace", "spacing", "paint", "defense", "playmaking", "rebounding")}
    feats = {
        "talent_mean": mean("talent"), "talent_top_two": (top("talent", 1) + top("talent", 2)) / 2.0, "talent_floor": F.get("talent", F.lit(0)),
        "scoring_mean": mean("pts"), "scoring_peak": top("pts", 1), "efficiency_mean": mean("eff"), "efficiency_floor": F.get("eff", F.lit(0)),
        "playmaking_mean": mean("creation"), "playmaking_peak": top("creation", 1), "rebounding_mean": mean("reb"), "defense_mean": c("defense_mean"),
        "availability_mean": mean("avail"), "availability_floor": F.get("avail", F.lit(0)),
        "spacing_coverage": F.size(F.filter("shooting", lambda x: x >= 60.0)) / n, "spacing_floor": top("shooting", 4) / 100.0,
        "creation_peak": top("creation", 1) / 100.0, "creation_support": top("creation", 2) / 100.0, "scoring_support": top("pts", 2) / 100.0,
        "perimeter_defense": top("stl", 2) / 100.0, "rim_protection": top("blk", 1) / 100.0, "rebounding_support": top("reb", 2) / 100.0,
        "two_way_coverage": c("two_way_coverage"), "role_coverage": kinds / 7.0, "role_entropy": F.when(kinds > 1, entropy).otherwise(0.0),
        "role_concentration": F.greatest(*counts) / 5.0, "skill_redundancy": rules.total(cosines) / 10.0, "skill_diversity": rules.total(gaps) / 10.0,
        "guard_share": c("guard_share"), "wing_share": c("wing_share"), "big_share": c("big_share"),
        "style_spacing": s["spacing"], "style_paint": s["paint"], "style_playmaking": s["playmaking"], "style_defense": s["defense"],
        "style_rebounding": s["rebounding"], "pace_extremity": F.abs(s["pace"] - 0.5) * 2.0, "inside_out_balance": 1.0 - F.abs(s["spacing"] - s["paint"]),
        "creation_spacing": F.sqrt(s["playmaking"] * s["spacing"]), "defense_rebounding": F.sqrt(s["defense"] * s["rebounding"]),
    }
    joined = g.join(styles, "unit_id")
    return joined.select("unit_id", "unit_season", *[v.cast("double").alias(k) for k, v in feats.items()])


# ---- composition and descriptors ---------------------------------------------------------------
def role_counts(rows: DataFrame, roles: str = "unit_roles") -> DataFrame:
    """Seven-part role vector per unit."""
    return rows.groupBy("unit_id").agg(F.array(*[F.sum(F.array_contains(roles, r).cast("double")) for r in P.ROLES]).alias("role_vector"))


def composition(rows: DataFrame) -> DataFrame:
    c = F.col
    per_game = lambda x: F.coalesce(F.try_divide(c(x), F.when(c("gp") == 0, 1.0).otherwise(c("gp"))), F.lit(0.0))
    has = lambda *r: rules.any_role(c("unit_roles"), *r)
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    return rows.groupBy("unit_id").agg(
        F.count_if(has("Playmaker")).alias("playmakers"), F.count_if(has("Secondary Creator", "Designated Scorer")).alias("creators"),
        F.count_if(rules.three_makes(c("fg3m"), c("min")) >= P.SHOOTER_MAKES).alias("shooters"),
        F.count_if(has("Interior Presence")).alias("bigs"),
        F.count_if(has("Defensive Specialist") | (zero("stl_per36_pctile") > 60.0) | (zero("blk_per36_pctile") > 65.0)).alias("defenders"),
        F.count_if((per_game("reb") >= 9.5) | (zero("reb_per36") >= 11.5)).alias("strong_rebounders"),
        F.count_if((per_game("blk") >= 1.2) | (zero("blk_per36") >= 1.6)).alias("rim_protectors"),
        F.count_if(per_game("ast") >= 6.0).alias("elite_passers"))


def descriptors(rows: DataFrame) -> DataFrame:
    """Skill percentiles of each member."""
    p = lambda m: F.coalesce(F.col(f"{m}_pctile"), F.lit(50.0))
    makes = rules.three_makes(F.col("fg3m"), F.col("min"))
    return rows.select("unit_id", F.col("player_id").alias("id"), "unit_roles", p("fg3a_rate").alias("shooting"), p("pts_per36").alias("scoring"),
                       p("ts_pct").alias("efficiency"), F.greatest(p("ast_per36"), p("ast_pct")).alias("playmaking"), p("reb_per36").alias("rebounding"),
                       p("blk_per36").alias("rim_protection"), p("stl_per36").alias("perimeter_defense"), p("fta_rate").alias("rim_pressure"),
                       F.greatest(p("stl_per36"), p("blk_per36")).alias("defense"), makes.alias("fg3m_per36"),
                       (makes >= P.SHOOTER_MAKES).alias("is_shooter"))


def training_rows(features: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Unit features with the outcome of their team season. outcomes: unit_id, win_pct."""
    return features.join(outcomes.where("win_pct is not null"), "unit_id").withColumnRenamed("unit_season", "season")
