"""Player queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import preset as P
from tallyframe.functions import rules, scores
from tallyframe.functions.clean import career_era, season_decade
from tallyframe.operators import career as C
from tallyframe.operators import pairs
from tallyframe.operators.ranking import with_zscores
from tallyframe.plans import profiles

from . import sqlbase as S
from .views import careers, features, part_rates, players, r6, rates, rolled, similar, text

Q, O = {}, {}
M = P.METRICS


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = sql
        return fn
    return add


@query("season_rates", f"""WITH {S.rates()} SELECT player_id, season, team, gp, "min", {S.r(*M)} FROM rates""")
def season_rates(spark, sf):
    return r6(rates(spark, sf).select("player_id", "season", "team", "gp", "min", *M))


@query("part_season_rates", f"""WITH {S.rates('part').replace("WHERE p_partkey = s.player_id", "WHERE p_partkey = s.player_id")}
SELECT player_id, season, team, {S.r(*M)} FROM rates""")
def part_season_rates(spark, sf):
    return r6(part_rates(spark, sf).select("player_id", "season", "team", *M))


@query("normalized_features", f"""WITH {S.feats()} SELECT player_id, season,
  {S.r(*[f'{m}{x}' for m in M for x in ('_z', '_pctile', '_pos_z')])} FROM feats""")
def normalized_features(spark, sf):
    return r6(features(spark, sf).select("player_id", "season", *[f"{m}{x}" for m in M for x in ("_z", "_pctile", "_pos_z")]))


@query("customer_percentiles", f"""WITH {S.feats('customer')} SELECT player_id, season,
  {S.r(*[f'{m}_pctile' for m in M])} FROM feats""")
def customer_percentiles(spark, sf):
    """The bigger pool: average-rank percentiles of 12 metrics."""
    out = C.with_percentiles(rates(spark, sf, "customer"), M, ["season"], ["player_id", "season"])
    return r6(out.select("player_id", "season", *[f"{m}_pctile" for m in M]))


@query("career_rollup", f"""WITH {S.careers()}, runs AS (SELECT player_id, season, team,
    lag(team) OVER (PARTITION BY player_id ORDER BY season) AS prev FROM feats),
lists AS (SELECT player_id, string_agg(team, '|' ORDER BY season) AS career_teams FROM runs
  WHERE prev IS NULL OR prev <> team GROUP BY player_id)
SELECT player_id, player_name, career_games, career_minutes, first_season, last_season, last_season_start, primary_position,
  position_group, height, weight, draft_year, draft_position, career_teams, {S.r(*M)}, {S.r(*[f'{m}_z' for m in M])}
FROM career JOIN lists USING (player_id)""")
def career_rollup(spark, sf):
    out = rolled(spark, sf)
    return r6(out.select("player_id", "player_name", "career_games", "career_minutes", "first_season", "last_season",
                         "last_season_start", "primary_position", "position_group", "height", "weight", "draft_year",
                         "draft_position", text("career_teams"), *M, *[f"{m}_z" for m in M]))


@query("career_percentiles", f"""WITH {S.careers()} SELECT player_id, bucket AS height_bucket,
  {S.r(*[f'{m}{x}' for m in M for x in ('_global_pctile', '_career_pctile')])} FROM career""")
def career_percentiles(spark, sf):
    return r6(careers(spark, sf).select("player_id", "height_bucket", *[f"{m}{x}" for m in M for x in ("_global_pctile", "_career_pctile")]))


@query("player_filter", f"""WITH {S.careers('customer')} SELECT player_id, career_games, last_season_start,
  (career_games >= 200)::INT AS in_pool, (career_games * mpg >= 300)::INT AS qualified
FROM career WHERE last_season_start >= 2002 - 3 + 1 OR career_games >= 82""")
def player_filter(spark, sf):
    kept = C.keep_players(rolled(spark, sf, "customer"), 2002)
    return kept.select("player_id", "career_games", "last_season_start", (F.col("career_games") >= 200).cast("int").alias("in_pool"),
                       C.qualified(F.col("career_games"), F.col("mpg")).cast("int").alias("qualified"))


@query("archetypes_roles", f"""WITH {S.feats()} SELECT player_id, season, array_to_string({S.archetypes()}, '|') AS archetypes,
  {S.role()} AS role FROM feats""")
def archetypes_roles(spark, sf):
    return C.add_labels(features(spark, sf)).select("player_id", "season", text("archetypes"), "role")


@query("archetype_listing", f"""WITH {S.careers()} SELECT player_id, player_name, role, career_span FROM career
WHERE list_contains(archetypes, 'box-score defender')""")
def archetype_listing(spark, sf):
    return profiles.players_with_archetype(careers(spark, sf), "Box Score Defender").select("player_id", "player_name", "role", "career_span")


@query("season_scores", f"""WITH {S.scored()} SELECT player_id, season, {S.r('pfv', 'apfv')} FROM scored""")
def season_scores(spark, sf):
    return r6(C.season_scores(features(spark, sf)).select("player_id", "season", "pfv", "apfv"))


@query("career_scores", f"""WITH {S.scored()} SELECT player_id, round(sum(apfv * "min") / sum("min"), 6) AS career_apfv
FROM scored WHERE "min" > 0 GROUP BY player_id""")
def career_scores(spark, sf):
    return r6(C.career_score(C.season_scores(features(spark, sf))))


LEADER_SQL = f"""WITH {S.scored()}, cs AS (SELECT player_id, max_by(player_name, season) AS player_name,
    sum(gp)::BIGINT AS games, sum("min") AS minutes, sum(apfv * "min") / sum("min") AS career_apfv, max(apfv) AS best_season
  FROM scored WHERE "min" > 0 GROUP BY player_id)
SELECT row_number() OVER (ORDER BY career_apfv DESC, player_id) AS place, player_id, player_name, games, minutes,
  {S.r('career_apfv', 'best_season')} FROM cs WHERE minutes >= 300 QUALIFY place <= 25"""


@query("leaderboard", LEADER_SQL)
def leaderboard(spark, sf):
    return r6(profiles.career_leaderboard(features(spark, sf), page_size=25))


@query("pool_impact", f"""WITH {S.careers()}, t AS (SELECT *, least(1.0, sqrt(career_minutes / 2500.0)) AS trust FROM career),
pf AS (SELECT *, {S.impact('_global_pctile', 'trust')} AS pfv FROM t),
a AS (SELECT *, pfv * sqrt(mpg_global_pctile / 100.0) * pow(least(1.0, sqrt(career_minutes / 4000.0)), 0.25) AS adjusted FROM pf)
SELECT player_id, {S.r('pfv', 'adjusted')}, round(least(pow(row_number() OVER (ORDER BY adjusted, player_id)::DOUBLE
  / count(*) OVER (), 1.2) * 0.99, 0.99), 6) AS apfv FROM a""")
def pool_impact(spark, sf):
    return r6(C.pool_impact(careers(spark, sf)).select("player_id", "pfv", "adjusted", "apfv"))


@query("caliber", f"""WITH {S.players()} SELECT player_id, bucket AS height_bucket, {S.r('polygon', 'caliber')} FROM player""")
def caliber(spark, sf):
    return r6(players(spark, sf).select("player_id", "height_bucket", "polygon", "caliber"))


def _display_sql() -> str:
    cols = []
    for m in M:
        p = f"(100.0 - {m}_global_pctile)" if m == "tov_per36" else f"{m}_global_pctile"
        cols.append(f"round(greatest(0.0, least(100.0, 50.0 + trust * ({p} - 50.0))), 6) AS {m}_shown")
    return f"""WITH {S.careers()}, t AS (SELECT *, least(1.0, sqrt(career_minutes / 2500.0)) AS trust FROM career)
SELECT player_id, {', '.join(cols)} FROM t"""


@query("display_percentiles", _display_sql())
def display_percentiles(spark, sf):
    trust = scores.credibility(F.col("career_minutes"))
    return r6(careers(spark, sf).select("player_id", *[
        scores.display_percentile(m, F.col(f"{m}_global_pctile"), trust).alias(f"{m}_shown") for m in M]))


def _ratings_sql() -> str:
    ax = P.SKILL_AXES
    mean = "(" + " + ".join(f"{a}_pctile" for a in ax) + ") / 6"
    cols = ", ".join(f"round(greatest(0.0, least(100.0, apfv * 100.0 + 0.75 * ({a}_pctile - {mean}))), 6) AS {a}_rating" for a in ax)
    scaled = ", ".join(f"round({a}_pctile * pow(mpg_pctile / 100.0, 1.5), 6) AS {a}_scaled" for a in ("pts_per36", "ts_pct"))
    back = """round(least(ts_pct_pctile / pow(mpg_pctile / 100.0, 1.5), 100.0), 6) AS ts_pct_unscaled"""
    return f"WITH {S.scored()} SELECT player_id, season, {cols}, {scaled}, {back} FROM scored"


@query("skill_ratings", _ratings_sql())
def skill_ratings(spark, sf):
    df = C.season_scores(features(spark, sf))
    pct = {a: F.col(f"{a}_pctile") for a in P.SKILL_AXES}
    rated = scores.skill_ratings(pct, F.col("apfv"))
    mpg = F.col("mpg_pctile")
    return r6(df.select("player_id", "season", *[c.alias(f"{a}_rating") for a, c in rated.items()],
                        *[scores.scale_by_minutes(a, pct[a], mpg).alias(f"{a}_scaled") for a in ("pts_per36", "ts_pct")],
                        scores.unscale_by_minutes("ts_pct", pct["ts_pct"], mpg).alias("ts_pct_unscaled")))


W = P.PLAYSTYLE_WEIGHTS
_VEC = "[" + ", ".join(f"{m}{{s}} / 100.0 * {w}" for m, w in zip(M, W)) + "]"


def similar_sql(src: str, sfx: str, join: str, h: str, part: str, key: str) -> str:
    return f"""pool AS (SELECT *, {_VEC.format(s=sfx)} AS vec, {h} AS h, weight::DOUBLE AS wt,
    split_part(first_season, '-', 1)::INT AS yr FROM {src}),
pair AS (SELECT a.player_id{key}, b.player_id AS similar_id,
    exp(-list_distance(a.vec, b.vec) / 2.2)
    * pow(exp(-pow(a.h - b.h, 2) / 288.0) * exp(-pow(a.wt - b.wt, 2) / 2592.0), 0.25)
    * exp(-pow(a.caliber - b.caliber, 2) / (2.0 * 0.35 * 0.35))
    * (1.0 + 0.10 * (1.0 - exp(-abs(a.yr - b.yr) / 14.0)))
    * (CASE WHEN a.role = b.role THEN 1.07 ELSE 1.0 END)
    * (1.0 + 0.18 * len(list_intersect(a.archetypes, b.archetypes))) AS composite
  FROM pool a JOIN pool b ON a.player_id <> b.player_id{join}),
top AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY composite DESC, similar_id) AS rank FROM pair
  QUALIFY rank <= 10)"""


SIMILAR = f"{S.players()}, {similar_sql('player', '_global_pctile', '', 'inches', 'player_id', '')}"
SIMILAR = SIMILAR.replace("SELECT a.player_id,", "SELECT a.player_id,")


@query("similar_players", f"""WITH {SIMILAR} SELECT player_id, similar_id, rank, round(composite, 6) AS composite,
  round(78.0 * pow(greatest(0.0, least(1.0, composite / 1.45)), 2.0), 6) AS similarity_score FROM top""")
def similar_players(spark, sf):
    return r6(similar(spark, sf))


def _explain_sql() -> str:
    gaps = []
    for i, (label, ms) in enumerate(P.EXPLANATION_AXES.items()):
        gap = " + ".join(f"abs(a.{m}_z - b.{m}_z)" for m in ms)
        gaps.append(f"{{'gap': ({gap}) / {len(ms)}, 'ord': {i}, 'label': '{label}'}}")
    return f"""WITH {SIMILAR}, g AS (SELECT t.player_id, t.similar_id, list_sort([{', '.join(gaps)}]) AS s
  FROM top t JOIN player a ON a.player_id = t.player_id JOIN player b ON b.player_id = t.similar_id)
SELECT player_id, similar_id, 'Closest match in ' || s[1].label || ', ' || s[2].label || ', and ' || s[3].label || '.' AS explanation FROM g"""


@query("similar_explained", _explain_sql())
def similar_explained(spark, sf):
    pool = players(spark, sf)
    near = similar(spark, sf)
    return pairs.explain_pairs(near, pool, {m: F.col(f"{m}_z") for m in M}).select("player_id", "similar_id", "explanation")


@query("embedding_rows", f"""WITH {S.careers()}, e AS (SELECT *, weight::DOUBLE AS weight_lbs, inches AS height_inches FROM career)
SELECT player_id, {', '.join(f'round({S.zscore(m + "_z")} * {P.EMBEDDING_WEIGHTS[m]}, 6) AS e_{m}' for m in M)},
  {', '.join(f'round({S.zscore(m)} * {P.EMBEDDING_WEIGHTS[m]}, 6) AS e_{m}' for m in ('height_inches', 'weight_lbs'))} FROM e""")
def embedding_rows(spark, sf):
    rows = pairs.embedding_rows(players(spark, sf))
    return r6(rows.select("player_id", *[f"e_{m}" for m in [*M, "height_inches", "weight_lbs"]]))


@query("embeddings")
def embeddings(spark, sf):
    """Sign of a component is arbitrary, so rows only: squared coordinates."""
    out = pairs.embeddings(players(spark, sf))
    return r6(out.select("player_id", *[F.pow(F.col("components")[i], F.lit(2.0)).alias(f"c{i + 1}_sq") for i in range(12)]))


def _bundle_sql() -> str:
    return f"""WITH {S.scored()}, lab AS (SELECT *, {S.archetypes()} AS archetypes, {S.role()} AS role, season AS first_season,
    CASE WHEN inches < 76 THEN 'guard' WHEN inches <= 80 THEN 'wing' WHEN inches < 84 THEN 'big' ELSE 'center' END AS bucket
  FROM scored),
poly AS (SELECT *, ({' + '.join(f'{a}_q / 100.0 * ({b}_q / 100.0)' for a, b in zip(P.SKILL_AXES, P.SKILL_AXES[1:] + P.SKILL_AXES[:1]))}) / 6
    * pow(mpg_q / 100.0, 1.5) AS polygon FROM lab),
player AS (SELECT *, least(pow({S.share_le('polygon', 'season, bucket')}, 1.5) * 0.99, 0.99) AS caliber FROM poly),
{similar_sql('player', '_pctile', ' AND a.season = b.season', 'inches', 'player_id, season', ', a.season')},
near AS (SELECT player_id, season, string_agg(similar_id::VARCHAR, '|' ORDER BY rank) AS near_ids FROM top GROUP BY player_id, season)
SELECT player_id, season, role, array_to_string(archetypes, '|') AS archetypes, {S.r('pfv', 'apfv')}, near_ids
FROM player LEFT JOIN near USING (player_id, season)"""


@query("season_bundle", _bundle_sql())
def season_bundle(spark, sf):
    out = profiles.season_bundle(features(spark, sf))
    return r6(out.select("player_id", "season", "role", text("archetypes"), "pfv", "apfv", F.array_join("similar", "|").alias("near_ids")))


@query("player_profile", f"""WITH {S.scored()}, cs AS (SELECT player_id, sum(apfv * "min") / sum("min") AS apfv, sum(gp)::BIGINT AS games,
    min(season) || ' to ' || max(season) AS span FROM scored WHERE "min" > 0 GROUP BY player_id)
SELECT player_id, games AS career_games, span AS career_span, round(apfv, 6) AS apfv, 12::INT AS n_metrics FROM cs WHERE player_id = 7""")
def player_profile(spark, sf):
    out = profiles.player_profile(features(spark, sf), careers(spark, sf), 7)
    return r6(out.select("player_id", "career_games", "career_span", "apfv", F.size("playstyle_metrics").alias("n_metrics")))


@query("player_seasons", f"""WITH {S.box()} SELECT player_id, string_agg(season, '|' ORDER BY season DESC) AS seasons FROM box GROUP BY player_id""")
def player_seasons(spark, sf):
    return profiles.player_seasons(rates(spark, sf)).select("player_id", text("seasons"))


@query("career_eras", f"""WITH {S.careers('customer')}, m AS (SELECT player_id,
    (split_part(first_season, '-', 1)::INT + split_part(last_season, '-', 1)::INT) / 2.0 AS mid, first_season FROM career)
SELECT player_id, CASE WHEN mid < 2001 THEN 'late-90s' WHEN mid < 2006 THEN 'early-2000s' ELSE 'late-2000s' END AS era,
  (split_part(first_season, '-', 1)::INT // 10 * 10)::VARCHAR || 's' AS decade FROM m""")
def career_eras(spark, sf):
    return rolled(spark, sf, "customer").select("player_id", career_era(F.col("career_span")).alias("era"), season_decade(F.col("first_season")).alias("decade"))


@query("season_leaders", f"""WITH {S.scored()}, lab AS (SELECT *, {S.role()} AS role FROM scored WHERE gp * mpg >= 300),
b AS (SELECT player_id, season, role, ts_pct AS sort_value, apfv, row_number() OVER (ORDER BY ts_pct ASC, apfv ASC, player_id) AS place FROM lab WHERE season = '1998-99' AND role = 'Rim Attacker')
SELECT player_id, season, place, round(sort_value, 6) AS sort_value, round(apfv, 6) AS apfv
FROM (SELECT *, least(2, greatest(1, ceil(count(*) OVER () / 5.0))) AS page FROM b) WHERE place BETWEEN 5 * page - 4 AND 5 * page""")
def season_leaders(spark, sf):
    """Second page (the last one if there is no second) of one role's players of a season by a box-score key, ascending."""
    scored = C.season_scores(C.add_labels(features(spark, sf)))
    items = profiles.leader_items(scored, "_pctile").where("season = '1998-99'")
    out = profiles.leaders(items, "box_ts_pct", False, "Rim Attacker", page=2, page_size=5, games="gp")
    return r6(out.select("player_id", "season", "place", "sort_value", "apfv"))


@query("customers_past_the_end", """SELECT c_custkey, place FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place, count(*) OVER () AS n FROM customer)
WHERE place > (n - 1) // 7 * 7""")
def customers_past_the_end(spark, sf):
    """A page far beyond the end is the last page, also where places are found by ranges."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_acctbal")
    out = profiles.page_of(rows, [F.col("c_acctbal").desc(), F.col("c_custkey")], 10**9, 7)
    return out.select("c_custkey", F.col("place").cast("bigint").alias("place"))


@query("customer_places", """SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS place FROM customer""")
def customer_places(spark, sf):
    """Places of all rows by range-sorted partitions."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey")
    return profiles.range_places(rows, [F.col("c_nationkey"), F.col("c_custkey")]).select("c_custkey", F.col("place").cast("bigint").alias("place"))


@query("leader_totals", f"""WITH {S.scored()}, lab AS (SELECT *, {S.role()} AS role FROM scored WHERE gp * mpg >= 300)
SELECT count(*) AS total, ceil(count(*) / 25.0)::BIGINT AS total_pages, array_to_string(list_sort(list(DISTINCT role)), '|') AS roles FROM lab""")
def leader_totals(spark, sf):
    out = profiles.page_totals(C.add_labels(features(spark, sf)), games="gp")
    return out.select("total", F.col("total_pages").cast("bigint").alias("total_pages"), text("roles"))
