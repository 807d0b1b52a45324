"""Model, diagnosis and unit-comparison queries."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from tallyframe import preset as P
from tallyframe.operators import history as H
from tallyframe.operators import lineups as L
from tallyframe.operators import model as M
from tallyframe.operators import teams as T
from tallyframe.plans import units as U

from . import lineups as K
from . import sqlbase as S
from .views import held, part_features, r6, stage, teams, text

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = sql
        return fn
    return add


def outcomes(spark, sf):
    return teams(spark, sf).select(F.concat(F.lit("T"), F.col("team_id").cast("string"), F.lit(":"), F.col("season")).alias("unit_id"), "w_pct")


def training(spark, sf):
    return stage(spark, sf, "training", lambda: L.training_rows(K.model_rows(spark, sf), outcomes(spark, sf).withColumnRenamed("w_pct", "win_pct")))


def fitted(spark, sf):
    """Out-of-fold predictions and what they came from: trained once for all model queries."""
    return held(spark, sf, "out_of_fold", lambda: M.out_of_fold(training(spark, sf)))


def league(spark, sf) -> U.League:
    def build():
        styles = T.style_vectors(teams(spark, sf)).select(F.concat(F.lit("T"), F.col("team_id").cast("string")).alias("team"), "season",
                                                          *[f"style_{a}" for a in P.STYLE_AXES])
        return U.League(part_features(spark, sf), K.pace(spark, sf), stage(spark, sf, "team_styles", lambda: styles),
                        L.baseline_reference(K.metrics(spark, sf)), M.train(training(spark, sf), held_out=fitted(spark, sf)))
    return held(spark, sf, "league", build)


def scored(spark, sf):
    return stage(spark, sf, "unit_scores", lambda: U.score(K.unit_table(spark, sf), league(spark, sf)).drop("strengths", "weaknesses"))


@query("training_rows", f"""WITH {K.FEATURES_SQL} SELECT unit_id, mf.season, round(w_pct, 6) AS win_pct, CASE WHEN w_pct >= 0.55 OR w_pct <= 0.45 THEN 1.5 ELSE 0.75 END::DOUBLE AS weight,
  {S.r('talent_mean', 'role_entropy', 'skill_diversity')} FROM mf JOIN team ON unit_id = 'T' || team_id || ':' || team.season""")
def training_rows(spark, sf):
    out = training(spark, sf).withColumn("weight", M.sample_weight(F.col("win_pct")))
    return r6(out.select("unit_id", "season", "win_pct", "weight", "talent_mean", "role_entropy", "skill_diversity"))


@query("out_of_fold_predictions")
def out_of_fold_predictions(spark, sf):
    oof, _ = fitted(spark, sf)
    return r6(oof.select("unit_id", "season", "win_pct", "quality_oof", "linear_oof", "boosted_oof"))


@query("unit_scores")
def unit_scores(spark, sf):
    return r6(scored(spark, sf).select("unit_id", "synergy_score", "quality_score", "fit_score", "projected_win_pct", "win_low", "win_high", "fit_delta_win_pct",
                                       "projected_wins", "fit_delta_wins", *[f"channel_{c}" for c in P.CHANNELS]))


@query("unit_diagnoses")
def unit_diagnoses(spark, sf):
    return scored(spark, sf).select("unit_id", text("strength_traits"), text("weakness_traits"), "primary_identity", "secondary_identity", "lead_id")


@query("diagnosis_grades")
def diagnosis_grades(spark, sf):
    picks = K.unit_table(spark, sf).select("unit_id").distinct().withColumn("picked", F.array(F.lit("+scoring"), F.lit("-spacing"), F.lit("unknown")))
    out = U.grade_diagnoses(scored(spark, sf), picks)
    return r6(out.select("unit_id", text("correct"), text("wrong"), text("missed"), "grade"))


@query("swap_evaluation")
def swap_evaluation(spark, sf):
    """Every swap of a starter for one of the team's starters of the season before."""
    units = K.unit_table(spark, sf)
    before = units.select(F.split("unit_id", ":")[0].alias("t"), "season", "player_id")
    start = lambda c: F.substring(c, 1, 4).cast("int")
    roster = (units.select("unit_id", F.split("unit_id", ":")[0].alias("t"), start("season").alias("y")).distinct()
              .join(before.select("t", (start("season") + 1).alias("y"), "player_id", F.col("season").alias("row_season")), ["t", "y"])
              .select("unit_id", "player_id", "row_season"))
    out = U.swaps(units, roster, league(spark, sf))
    return r6(out.select("base_id", "out_id", "in_id", "delta", "best_delta", "verdict", "grade", *[text(c) for c in ("improved", "regressed", "gained", "lost", "fixed", "opened")]))


@query("challenge_pool")
def challenge_pool(spark, sf):
    return r6(U.challenge_pool(scored(spark, sf)).select("unit_id", "synergy_score"))


@query("tied_pool", """WITH v AS (SELECT o_orderkey AS unit_id, o_orderkey % 7 AS score FROM orders),
s AS (SELECT list(score ORDER BY score) AS l FROM v) SELECT unit_id, score::DOUBLE AS score FROM v, s WHERE score <= l[round_even(0.4 * (len(l) - 1), 0)::INT + 1]""")
def tied_pool(spark, sf):
    """The pool below a rank over values that nearly all tie."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("unit_id"), (F.col("o_orderkey") % 7).cast("double").alias("score"))
    return U.challenge_pool(rows, "score").select("unit_id", "score")


def sides(spark, sf, edges=None):
    def build():
        rows = K.rows(spark, sf)
        roles = part_features(spark, sf).groupBy("player_id").agg(F.mode("position_group", True).alias("role"))
        style = K.blended(spark, sf).select("unit_id", F.array(*[F.col(f"v_{a}") / 100.0 for a in P.STYLE_KEYS]).alias("style"))
        shape = (rows.select("unit_id", "unit_season").distinct().withColumnRenamed("unit_season", "season").join(L.role_counts(rows), "unit_id")
                 .join(style, "unit_id").join(outcomes(spark, sf).withColumnRenamed("w_pct", "win_pct"), "unit_id")
                 .withColumn("team_id", F.expr("cast(substring(split(unit_id, ':')[0], 2) as bigint)")))
        return H.unit_sides(rows, shape, edges, roles)
    return stage(spark, sf, "unit_sides", build)


def _perm_max() -> str:
    return "greatest(" + ", ".join(" + ".join(f"m[{i * 5 + j + 1}]" for i, j in enumerate(p)) for p in permutations(range(5))) + ")"


_RV = ", ".join(f"count(*) FILTER (list_contains(roles, '{r}'))::DOUBLE" for r in P.ROLES)
_W = P.STYLE_AFFINITY_WEIGHTS


@query("similar_units", f"""WITH {K.BLEND},
u AS (SELECT ur.unit_id, list(player_id ORDER BY player_id) AS ids, list(position_group ORDER BY player_id) AS pr, [{_RV}] AS rv FROM ur GROUP BY ur.unit_id),
s AS (SELECT u.*, [{', '.join(f'v_{a} / 100.0' for a in P.STYLE_KEYS)}] AS st, w_pct FROM u JOIN bl USING (unit_id) JOIN team ON unit_id = 'T' || team_id || ':' || team.season),
p AS (SELECT a.unit_id, b.unit_id AS key, len(list_intersect(a.ids, b.ids)) AS ov, a.rv AS arv, b.rv AS brv, a.st AS ast_, b.st AS bst, a.w_pct AS aw, b.w_pct AS bw,
  flatten(list_transform(a.ids, lambda x, i: list_transform(b.ids, lambda y, j: CASE WHEN x = y THEN 11.0 WHEN a.pr[i] = b.pr[j] THEN 0.35 ELSE 0.15 END))) AS m FROM s a, s b),
q AS (SELECT unit_id, key, ov, ({_perm_max()} - 10.0 * ov) / 5.0 AS ps, coalesce(list_inner_product(arv, brv) / nullif(sqrt(list_inner_product(arv, arv)) * sqrt(list_inner_product(brv, brv)), 0), 0) AS rs,
  greatest(0.0, 1.0 - sqrt(({' + '.join(f'pow(ast_[{i + 1}] - bst[{i + 1}], 2) * {w}' for i, w in enumerate(_W))}) / {sum(_W)}) / 0.78) AS ss,
  greatest(0.0, 1.0 - abs(aw - bw) / 0.52) AS qs FROM p),
b AS (SELECT *, least(0.55, 0.12 + 0.10 * ov + 0.22 * greatest(0.0, ps - 0.35)) AS w FROM q), c AS (SELECT *, w * ps + (1 - w) * (0.54 * ss + 0.26 * rs + 0.20 * qs) AS base FROM b),
d AS (SELECT *, base + CASE WHEN ps >= 0.6 THEN pow((ps - 0.6) / 0.4, 2) ELSE 0 END * (ps - base) AS mix FROM c),
e AS (SELECT unit_id, key, ov::INT AS overlap, 100.0 * CASE WHEN ov >= 2 THEN least(1.0, mix + 0.045 * (ov - 1)) ELSE mix END AS similarity FROM d)
SELECT unit_id, key, overlap, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY unit_id ORDER BY similarity DESC, key) AS rank FROM e QUALIFY rank <= 10""")
def similar_units(spark, sf):
    found = H.most_similar(sides(spark, sf), sides(spark, sf))
    return r6(found.select("unit_id", "key", "overlap", "similarity", "rank"))


@query("varied_similar_units")
def varied_similar_units(spark, sf):
    return r6(H.varied_units(sides(spark, sf), sides(spark, sf)).select("unit_id", "key", "place", "decade", "similarity"))
