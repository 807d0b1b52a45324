"""Unit read queries: synergy of any number of units, diagnosis grades, swaps; and the artifact chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import preset as P
from ..functions import rules, scores
from ..operators import diagnoses as D
from ..operators import history as H
from ..operators import lineups as L
from ..operators import model as M
from ..operators.name_index import NameIndex, search_index
from ..session import cut_lineage


@dataclass
class League:
    """What scoring reads: season features, team pace and style, baseline values, the model."""
    features: DataFrame
    pace: DataFrame
    styles: DataFrame
    reference: DataFrame
    model: M.UnitModel | None = None


def build_league(features: DataFrame, pace: DataFrame, styles: DataFrame, units: DataFrame, outcomes: DataFrame,
                 stored: DataFrame | None = None, params: M.TrainParams = M.TrainParams()) -> League:
    """The chain in order: baselines (stored seasons are kept), model."""
    rows = cut_lineage(L.complete_units(L.season_unit_rows(units, features, pace)))
    metrics = cut_lineage(L.collective(rows))
    reference = cut_lineage(L.baseline_reference(metrics, stored))
    made = L.model_features(rows, L.style_percentiles(metrics, reference))
    model = M.train(L.training_rows(made, outcomes), params)
    return League(features, pace, styles, reference, model)


def score(units: DataFrame, league: League) -> DataFrame:
    """Scores, style, composition and diagnoses of complete units. units: unit_id, season, player_id [, row_season]."""
    rows = cut_lineage(L.complete_units(L.unit_rows(units, league.features, league.pace)))
    metrics = L.collective(rows)
    style = cut_lineage(L.style_percentiles(metrics, league.reference))
    scored = M.score_units(L.model_features(rows, style), league.model)
    mixed = L.blend_team_style(style, rows, league.styles).drop("unit_season")
    out = scored.join(mixed, "unit_id").join(L.composition(rows), "unit_id").join(D.unit_supports(L.descriptors(rows)), "unit_id")
    out = cut_lineage(out.withColumns({
        **{f"dim_{d}": F.col(f"v_{d}") for d in ("playmaking", "rebounding", "paint", "defense", "pace")},
        "dim_spacing": F.col("s_spacing"), "dim_scoring": F.col("quality_score")}))
    done = D.diagnose(out)
    seen = scores.outlook(F.col("projected_win_pct"), F.col("fit_delta_win_pct"))
    return done.withColumns(seen | {"strength_traits": D.trait_list(F.col("strengths"), "+"), "weakness_traits": D.trait_list(F.col("weaknesses"), "-")})


ALL_TRAITS = [f"+{t}" for t in P.TRAITS] + [f"-{t}" for t in [*P.TRAITS, "overlap"]]


def search_season(index: NameIndex, query: str, season: str, limit: int = 8) -> DataFrame:
    """The best names among one season's rows, as members to build a unit from. The index is over season features, scope season.
    Of rows that are prospects the columns that tell their origin go along; a table without them holds none."""
    found = search_index(index.within(season=season), query, limit)
    also = [F.col(c) if c in found.columns else F.lit(None).cast(t).alias(c) for c, t in {
        "prospect_id": "string", "counterpart_id": "long", "counterpart_name": "string"}.items()]
    prospect = F.coalesce(F.col("is_prospect"), F.lit(False)) if "is_prospect" in found.columns else F.lit(False)
    return found.select(
        "player_id", F.col(index.name).alias("name"), F.coalesce("team", F.lit("")).alias("team"),
        F.get(rules.unit_roles(rules.zcols()), F.lit(0)).alias("role"), F.coalesce("pts_per36", F.lit(0.0)).alias("pts_per36"),
        F.when(F.col("gp") > 0, F.coalesce("min", F.lit(0.0)) / F.col("gp")).otherwise(0.0).alias("mpg"), prospect.alias("is_prospect"), *also, "score")


def grade_diagnoses(scored: DataFrame, picks: DataFrame) -> DataFrame:
    """picks: unit_id, picked array<string> of marked traits."""
    truth = F.concat("strength_traits", "weakness_traits")
    known = F.array(*map(F.lit, ALL_TRAITS))
    return scored.join(picks, "unit_id").select("unit_id", *[c.alias(k) for k, c in D.grade_picks(truth, F.col("picked"), known).items()])


def swaps(units: DataFrame, roster: DataFrame, league: League) -> DataFrame:
    """Every swap of every unit with its win delta, verdict and grade against the unit's best swap, scored as one batch."""
    cand = cut_lineage(H.swap_candidates(units, roster))
    before = score(units, league).select(F.col("unit_id").alias("base_id"), F.col("projected_win_pct").alias("old_win"),
                                         F.col("strength_traits").alias("old_s"), F.col("weakness_traits").alias("old_w"))
    after = score(cand.select("unit_id", "season", "player_id", "row_season"), league)
    plain = lambda c: F.transform(c, lambda x: F.substring(x, 2, 100))
    both = (after.join(cand.select("unit_id", "base_id", "out_id", "in_id").distinct(), "unit_id").join(before, "base_id")
            .withColumn("delta", F.col("projected_win_pct") - F.col("old_win")))
    best = both.groupBy("base_id").agg(F.greatest(F.lit(0.0), F.max("delta")).alias("best_delta"))
    changes = D.trait_changes(plain("old_s"), plain("strength_traits"), plain("old_w"), plain("weakness_traits"))
    return both.join(best, "base_id").select(
        "base_id", "out_id", "in_id", "delta", "best_delta", scores.verdict(F.col("delta") * 82.0).alias("verdict"),
        D.roster_grade(F.col("delta"), F.col("best_delta")).alias("grade"), *[c.alias(k) for k, c in changes.items()])


def challenge_pool(scored: DataFrame, value: str = "synergy_score", share: float = 0.40) -> DataFrame:
    """Units at or below the value at the rounded position share * (n - 1) of the sorted values."""
    from ..operators.ranking import with_ordinal

    placed = with_ordinal(scored.where(F.col(value).isNotNull()), value, [], ["unit_id"])
    bar = placed.where(F.col("ord") - 1 == F.bround(share * (F.col("ord_n") - 1), 0)).agg(F.max(value).alias("_bar"))
    return scored.crossJoin(F.broadcast(bar)).where(F.col(value) <= F.col("_bar")).drop("_bar")  # one row
