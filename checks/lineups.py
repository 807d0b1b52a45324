"""Unit queries and their oracles. Units: the five heaviest-minutes parts of a brand season, and named groups of five."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe import preset as P
from tallyframe.operators import lineups as L
from tallyframe.operators import teams as T
from tallyframe.operators.name_index import name_index
from tallyframe.operators.ranking import with_ordinal
from tallyframe.plans.units import search_season

from . import sqlbase as S
from .teams import TEAM
from .views import part_features, part_rates, r6, stage, teams, text

Q, O = {}, {}
M = P.METRICS


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = sql
        return fn
    return add


# ---- inputs -----------------------------------------------------------------------------
def groups(spark, sf):
    """Named fives: the roster in id order, cut into fives, labelled 'A. Last - ...', each with its members' sums."""
    def build():
        roster = part_rates(spark, sf).select("team", "season", "player_id", "player_name", "gp", "min")
        rows = with_ordinal(roster, "player_id", ["team", "season"], ["player_id"]).withColumn("i", F.col("ord") - 1)
        rows = rows.withColumn("five", F.floor(F.col("i") / 5))
        words = F.split("player_name", " ")
        short = F.concat(F.substring(words[0], 1, 1), F.lit(". "), words[1])
        return rows.groupBy("team", "season", "five").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", short.alias("s")))), lambda x: x["s"]), " - ").alias("group_name"),
            F.sum("gp").alias("gp"), F.sum("min").alias("min"))
    return stage(spark, sf, "groups", build)


def starters(spark, sf):
    return stage(spark, sf, "starters", lambda: L.starting_lineups(groups(spark, sf), T.per_game(part_rates(spark, sf)), 2, 2, 18.0))


def unit_table(spark, sf):
    """The five parts with the most minutes per brand season."""
    def build():
        w = Window.partitionBy("team", "season").orderBy(F.col("min").desc(), "player_id")
        five = part_rates(spark, sf).withColumn("i", F.row_number().over(w)).where("i <= 5")
        return five.select(F.concat_ws(":", "team", "season").alias("unit_id"), "season", "player_id")
    return stage(spark, sf, "units", build)


def pace(spark, sf):
    return teams(spark, sf).select(F.concat(F.lit("T"), F.col("team_id").cast("string")).alias("team"), "season", "pace")


def rows(spark, sf):
    return stage(spark, sf, "unit_rows", lambda: L.complete_units(L.season_unit_rows(
        unit_table(spark, sf), part_features(spark, sf), pace(spark, sf))))


def metrics(spark, sf):
    return stage(spark, sf, "unit_metrics", lambda: L.collective(rows(spark, sf)))


def styles(spark, sf):
    return stage(spark, sf, "unit_styles", lambda: L.style_percentiles(metrics(spark, sf), L.baseline_reference(metrics(spark, sf))))


def blended(spark, sf):
    def build():
        team = T.style_vectors(teams(spark, sf)).withColumn("team", F.concat(F.lit("T"), F.col("team_id").cast("string")))
        return L.blend_team_style(styles(spark, sf), rows(spark, sf), team.select("team", "season", *[f"style_{a}" for a in P.STYLE_AXES]))
    return stage(spark, sf, "blended", build)


def model_rows(spark, sf):
    return stage(spark, sf, "model_rows", lambda: L.model_features(rows(spark, sf), styles(spark, sf)))


# ---- SQL --------------------------------------------------------------------------------
PART = S.feats("part")


def _a(m, t): return f"{m}_z > {t} + 1e-9"
def _b(m, t): return f"{m}_z < {t} - 1e-9"


_IN = f"(({_a('reb_per36', .7)} OR {_a('blk_per36', .7)}) AND {_b('fg3a_rate', -.4)})"
_ROLES = f"""list_filter([CASE WHEN {_a('ast_per36', .8)} AND {_a('ast_pct', .6)} THEN 'Playmaker'
    WHEN {_a('pts_per36', .8)} AND {_b('ast_pct', .4)} THEN 'Designated Scorer' WHEN {_a('ast_per36', .2)} AND {_a('pts_per36', 0)} THEN 'Secondary Creator' END,
  CASE WHEN {_a('fg3a_rate', .6)} THEN 'Perimeter Specialist' WHEN {_a('fta_rate', .5)} AND {_a('pts_per36', 0)} THEN 'Rim Attacker' END,
  CASE WHEN {_IN} THEN 'Interior Presence' END,
  CASE WHEN ({_a('stl_per36', .8)} OR {_a('blk_per36', .8)}) AND NOT {_IN} THEN 'Defensive Specialist' END], lambda x: x IS NOT NULL)"""
UROLES = f"""(CASE WHEN len({_ROLES}) > 0 THEN {_ROLES}[1:2] WHEN {_a('pts_per36', 0)} THEN ['Secondary Creator']
  WHEN {_a('reb_per36', 0)} THEN ['Interior Presence'] ELSE ['Defensive Specialist'] END)"""
UNITS = f"""{PART},
{TEAM.split(S.LINES + ',', 1)[1]},
urows AS (SELECT f.*, f.team || ':' || f.season AS unit_id, {UROLES} AS roles, coalesce(t.pace, 98.0) AS tpace,
    row_number() OVER (PARTITION BY f.team, f.season ORDER BY f."min" DESC, player_id) AS pos
  FROM feats f LEFT JOIN team t ON f.team = 'T' || t.team_id AND f.season = t.season QUALIFY pos <= 5),
whole AS (SELECT unit_id FROM urows GROUP BY unit_id HAVING count(*) = 5),
ur AS (SELECT * FROM urows JOIN whole USING (unit_id)),
coll AS (SELECT unit_id, season, sum(tpace * mpg) / sum(mpg) AS pace, sum(fg3a / "min" * 36.0) * 1.3333 AS fg3a, avg(fg3m / "min" * 36.0) AS space,
    sum(greatest(0.0, (fga - fg3a) * CASE WHEN reb_per36_z > 0.5 + 1e-9 OR blk_per36_z > 0.5 + 1e-9 THEN 0.80
      WHEN fg3a / fga > 0.45 + 1e-9 THEN 0.30 ELSE 0.45 END) / "min" * 36.0) * 1.3333 AS paint_fga,
    sum(stl / "min" * 36.0 + 1.2 * (blk / "min" * 36.0) + CASE roles[1] WHEN 'Defensive Specialist' THEN 1.5 WHEN 'Interior Presence' THEN 1.0 ELSE 0.0 END) AS def_score,
    sum(ast / "min" * 36.0) * 1.3333 AS ast, sum(fgm / "min" * 36.0) * 1.3333 AS fgm, sum(reb / "min" * 36.0) * 1.3333 AS reb,
    sum(blk / "min" * 36.0) * 1.3333 AS blk FROM ur GROUP BY unit_id, season),
met AS (SELECT *, CASE WHEN fgm > 0 THEN ast / fgm * 100.0 ELSE 0.0 END AS ast_pct FROM coll)"""
_MID = {m: f"((2 * rank() OVER (PARTITION BY season ORDER BY {m}) - 2 + count(*) OVER (PARTITION BY season, {m})) / (2.0 * count(*) OVER (PARTITION BY season)) * 100.0)"
        for m in P.BASELINE_METRICS}
STYLES = f"""{UNITS},
sty AS (SELECT unit_id, season, {_MID['pace']} AS s_pace, {_MID['space']} AS s_spacing, {_MID['paint_fga']} AS s_paint, {_MID['def_score']} AS s_defense,
    0.55 * {_MID['ast']} + 0.45 * {_MID['ast_pct']} AS s_playmaking, {_MID['reb']} AS s_rebounding FROM met)"""
_SK = ["s_pace", "s_spacing", "s_paint", "s_defense", "s_playmaking", "s_rebounding"]


@query("unit_roles", f"WITH {UNITS} SELECT unit_id, player_id, array_to_string(roles, '|') AS roles FROM ur")
def unit_roles(spark, sf):
    return rows(spark, sf).select("unit_id", "player_id", F.array_join("unit_roles", "|").alias("roles"))


@query("unit_metrics", f"WITH {UNITS} SELECT unit_id, {S.r(*P.BASELINE_METRICS)}, round(reb + 4.0 * blk, 6) AS paint_score FROM met")
def unit_metrics(spark, sf):
    return r6(metrics(spark, sf).select("unit_id", *P.BASELINE_METRICS, "paint_score"))


@query("season_baselines", f"""WITH {UNITS}, l AS (UNPIVOT (SELECT season, {', '.join(P.BASELINE_METRICS)} FROM met) ON {', '.join(P.BASELINE_METRICS)} INTO NAME metric VALUE v)
SELECT season, metric, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max
FROM l GROUP BY season, metric HAVING count(*) >= 5""")
def season_baselines(spark, sf):
    return r6(L.season_baselines(metrics(spark, sf)))


@query("unit_styles", f"WITH {STYLES} SELECT unit_id, {S.r(*_SK)} FROM sty")
def unit_styles(spark, sf):
    return r6(styles(spark, sf).select("unit_id", *_SK))


_SHARE = {"pace": .4, "paint": .4, "defense": .3, "playmaking": .6, "rebounding": .4}
BLEND = f"""{STYLES}, tsty AS (SELECT 'T' || team_id AS team, season, {', '.join(
    f"{S.avg_rank(c if sign > 0 else f'(-{c})', 'season')} AS style_{a}" for a, (c, sign) in P.STYLE_AXES.items())} FROM team),
own AS (SELECT unit_id, {', '.join(f'avg(coalesce(style_{a}, 50.0)) AS t_{a}' for a in P.STYLE_KEYS)} FROM ur LEFT JOIN tsty USING (team, season) GROUP BY unit_id),
bl AS (SELECT unit_id, season, {', '.join(f'greatest(0.0, least(100.0, {s} * s_{a} + {1 - s} * t_{a})) AS v_{a}' for a, s in _SHARE.items())},
  s_spacing AS v_three_point_volume FROM sty JOIN own USING (unit_id))"""


@query("unit_style_blend", f"WITH {BLEND} SELECT unit_id, {S.r(*[f'v_{a}' for a in P.STYLE_KEYS])} FROM bl")
def unit_style_blend(spark, sf):
    return r6(blended(spark, sf).select("unit_id", *[f"v_{a}" for a in P.STYLE_KEYS]))


def _features_sql() -> str:
    p = lambda m: f"{m}_pctile"
    skills = ["pts", "creation", "shooting", "rim", "reb", "stl", "blk", "eff"]
    pairs_ = [(i, j) for i in range(1, 6) for j in range(i + 1, 6)]
    cos = " + ".join(f"coalesce(list_inner_product(m[{i}], m[{j}]) / nullif(sqrt(list_inner_product(m[{i}], m[{i}])) * sqrt(list_inner_product(m[{j}], m[{j}])), 0), 0)" for i, j in pairs_)
    gap = " + ".join(f"list_distance(m[{i}], m[{j}]) / sqrt(8.0)" for i, j in pairs_)
    cnt = ", ".join(f"count(*) FILTER (list_contains(roles, '{r}'))::DOUBLE AS n{i}" for i, r in enumerate(P.ROLES))
    tot = "(" + " + ".join(f"n{i}" for i in range(7)) + ")"
    kinds = "(" + " + ".join(f"(n{i} > 0)::INT" for i in range(7)) + ")"
    ent = " + ".join(f"CASE WHEN n{i} > 0 THEN n{i} / {tot} * ln(n{i} / {tot}) ELSE 0 END" for i in range(7))
    lists = ", ".join(f"list_sort(list({k})) AS l_{k}" for k in ["pts", "creation", "shooting", "reb", "stl", "blk", "eff", "avail", "talent"])
    out = {
        "talent_mean": "list_avg(l_talent)", "talent_top_two": "(l_talent[5] + l_talent[4]) / 2", "talent_floor": "l_talent[1]", "scoring_mean": "list_avg(l_pts)",
        "scoring_peak": "l_pts[5]", "efficiency_mean": "list_avg(l_eff)", "efficiency_floor": "l_eff[1]", "playmaking_mean": "list_avg(l_creation)",
        "playmaking_peak": "l_creation[5]", "rebounding_mean": "list_avg(l_reb)", "defense_mean": "dm", "availability_mean": "list_avg(l_avail)",
        "availability_floor": "l_avail[1]", "spacing_coverage": "len(list_filter(l_shooting, lambda x: x >= 60.0)) / 5.0", "spacing_floor": "l_shooting[2] / 100",
        "creation_peak": "l_creation[5] / 100", "creation_support": "l_creation[4] / 100", "scoring_support": "l_pts[4] / 100", "perimeter_defense": "l_stl[4] / 100",
        "rim_protection": "l_blk[5] / 100", "rebounding_support": "l_reb[4] / 100", "two_way_coverage": "tw / 5.0", "role_coverage": f"{kinds} / 7.0",
        "role_entropy": f"CASE WHEN {kinds} > 1 THEN -({ent}) / ln(7.0) ELSE 0 END", "role_concentration": "greatest(n0, n1, n2, n3, n4, n5, n6) / 5.0",
        "skill_redundancy": f"({cos}) / 10.0", "skill_diversity": f"({gap}) / 10.0", "guard_share": "gs / 5.0", "wing_share": "ws / 5.0", "big_share": "bs / 5.0",
        "style_spacing": "s_spacing / 100", "style_paint": "s_paint / 100", "style_playmaking": "s_playmaking / 100", "style_defense": "s_defense / 100",
        "style_rebounding": "s_rebounding / 100", "pace_extremity": "abs(s_pace / 100 - 0.5) * 2", "inside_out_balance": "1 - abs(s_spacing / 100 - s_paint / 100)",
        "creation_spacing": "sqrt(s_playmaking / 100 * s_spacing / 100)", "defense_rebounding": "sqrt(s_defense / 100 * s_rebounding / 100)",
    }
    return f"""{STYLES}, k AS (SELECT unit_id, player_id, roles, position_group, {p('pts_per36')} AS pts, 0.55 * {p('ast_per36')} + 0.45 * {p('ast_pct')} AS creation,
    {p('fg3a_rate')} AS shooting, {p('fta_rate')} AS rim, {p('reb_per36')} AS reb, {p('stl_per36')} AS stl, {p('blk_per36')} AS blk, {p('ts_pct')} AS eff, {p('mpg')} AS avail,
    greatest({p('stl_per36')}, {p('blk_per36')}) AS defense FROM ur),
k2 AS (SELECT *, 0.25 * pts + 0.17 * creation + 0.13 * reb + 0.12 * defense + 0.18 * eff + 0.15 * avail AS talent FROM k),
g AS (SELECT unit_id, {lists}, avg(defense) AS dm, count(*) FILTER (pts + eff >= 120 AND defense >= 60) AS tw, list([{', '.join(f'{s} / 100.0' for s in skills)}]) AS m, {cnt},
    count(*) FILTER (position_group = 'G') AS gs, count(*) FILTER (position_group = 'W') AS ws, count(*) FILTER (position_group = 'B') AS bs FROM k2 GROUP BY unit_id),
mf AS (SELECT unit_id, season, {', '.join(f'({v}) AS {k}' for k, v in out.items())} FROM g JOIN sty USING (unit_id))"""


FEATURES_SQL = _features_sql()


@query("unit_model_features", f"WITH {FEATURES_SQL} SELECT unit_id, {S.r(*P.QUALITY_FEATURES, *P.FIT_FEATURES)} FROM mf")
def unit_model_features(spark, sf):
    return r6(model_rows(spark, sf).select("unit_id", *P.QUALITY_FEATURES, *P.FIT_FEATURES))


@query("unit_composition", f"""WITH {UNITS} SELECT unit_id, count(*) FILTER (list_contains(roles, 'Playmaker')) AS playmakers,
  count(*) FILTER (list_contains(roles, 'Secondary Creator') OR list_contains(roles, 'Designated Scorer')) AS creators,
  count(*) FILTER (fg3m / "min" * 36.0 >= 1.8) AS shooters, count(*) FILTER (list_contains(roles, 'Interior Presence')) AS bigs,
  count(*) FILTER (list_contains(roles, 'Defensive Specialist') OR stl_per36_pctile > 60 OR blk_per36_pctile > 65) AS defenders,
  count(*) FILTER (reb / gp >= 9.5 OR reb_per36 >= 11.5) AS strong_rebounders, count(*) FILTER (blk / gp >= 1.2 OR blk_per36 >= 1.6) AS rim_protectors,
  count(*) FILTER (ast / gp >= 6) AS elite_passers FROM ur GROUP BY unit_id""")
def unit_composition(spark, sf):
    return L.composition(rows(spark, sf))


@query("unit_descriptors", f"""WITH {UNITS} SELECT unit_id, player_id AS id, round(fg3a_rate_pctile, 6) AS shooting, round(greatest(ast_per36_pctile, ast_pct_pctile), 6) AS playmaking,
  round(greatest(stl_per36_pctile, blk_per36_pctile), 6) AS defense, round(fg3m / "min" * 36.0, 6) AS fg3m_per36, (fg3m / "min" * 36.0 >= 1.8)::INT AS is_shooter FROM ur""")
def unit_descriptors(spark, sf):
    out = L.descriptors(rows(spark, sf)).withColumn("is_shooter", F.col("is_shooter").cast("int"))
    return r6(out.select("unit_id", "id", "shooting", "playmaking", "defense", "fg3m_per36", "is_shooter"))


_RS = {"Playmaker": "ast * 1.15 + ast_fga * 0.55 - pts * 0.08", "Secondary Creator": "ast * 0.9 + pts * 0.45 + stl * 0.05", "Designated Scorer": "pts * 1.15 - ast * 0.05",
       "Perimeter Specialist": "fg3a * 0.75 + fg3_pct * 0.9 + pts * 0.1", "Rim Attacker": "pts * 0.7 + (1.0 - fg3a) * 0.4 + ast * 0.05",
       "Interior Presence": "reb * 0.6 + blk * 0.9 + (1.0 - fg3a) * 0.35", "Defensive Specialist": "stl * 0.9 + blk * 0.5 + (1.0 - fg3a) * 0.1"}
_N = ["pts", "ast", "reb", "fg3a", "fg3_pct", "blk", "stl", "ast_fga"]


@query("starting_lineups", f"""WITH {S.box('part')}, b2 AS (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY player_id) - 1 AS i FROM box),
fives AS (SELECT team, season, i // 5 AS five, sum(gp) AS ggp, sum("min") AS gmin, count(*) AS n,
    string_agg(player_name[1] || '. ' || split_part(player_name, ' ', 2), ' - ' ORDER BY i) AS group_name FROM b2 GROUP BY ALL),
topg AS (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY (ggp < 2)::INT, gmin DESC, group_name) AS rn FROM fives QUALIFY rn = 1),
pg AS (SELECT team, season, player_id, i, gp, "min" / gp AS mpg, pts / gp AS pts, ast / gp AS ast, reb / gp AS reb, stl / gp AS stl, blk / gp AS blk, fg3a / gp AS fg3a,
    coalesce(fg3m / nullif(fg3a, 0), 0) AS fg3_pct, fga / gp AS fga FROM b2),
cand AS (SELECT pg.*, t.gmin / t.ggp AS lineup_mpg, i % 5 AS pos FROM pg JOIN topg t ON pg.team = t.team AND pg.season = t.season AND pg.i // 5 = t.five AND t.n = 5),
ok AS (SELECT team, season FROM cand GROUP BY ALL HAVING min(mpg) >= 18),
found AS (SELECT cand.*, 'lineup_minutes' AS source FROM cand JOIN ok USING (team, season)),
heavy AS (SELECT pg.*, NULL::DOUBLE AS lineup_mpg, row_number() OVER (PARTITION BY team, season ORDER BY mpg DESC, player_id) - 1 AS pos FROM pg WHERE gp >= 2 QUALIFY pos < 5),
fb AS (SELECT heavy.*, 'minutes_fallback' AS source FROM heavy ANTI JOIN ok USING (team, season)
  WHERE (team, season) IN (SELECT (team, season) FROM heavy GROUP BY team, season HAVING count(*) = 5)),
st AS (SELECT * FROM found UNION ALL BY NAME SELECT * FROM fb), st2 AS (SELECT *, ast / CASE WHEN fga = 0 THEN 1 ELSE fga END AS ast_fga FROM st),
nm AS (SELECT team, season, player_id, gp, mpg, pos, source, lineup_mpg, ast AS ast_raw, {', '.join(
    f'CASE WHEN max({c}) OVER w <= min({c}) OVER w THEN 0.5 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END AS {c}' for c in _N)}
  FROM st2 WINDOW w AS (PARTITION BY team, season)),
sc AS (SELECT *, list_sort([{', '.join(f"{{'neg': -({e}), 'ord': {i}, 'role': '{r}'}}" for i, (r, e) in enumerate(_RS.items()))}]) AS s FROM nm),
pick AS (SELECT *, list_filter(s[2:], lambda x: -x.neg >= 0.55 - 1e-9 AND x.neg - s[1].neg <= 0.16 + 1e-9
    AND NOT (list_contains(['Playmaker', 'Secondary Creator'], x.role) AND list_contains(['Playmaker', 'Secondary Creator'], s[1].role))) AS sec FROM sc)
SELECT team, season, player_id, pos::INT AS pos, source, round(mpg, 6) AS mpg, round(lineup_mpg, 6) AS lineup_mpg,
  CASE WHEN -s[1].neg < 0.45 - 1e-9 THEN CASE WHEN ast_raw >= 6 AND ast >= 0.78 THEN 'Playmaker' ELSE 'Secondary Creator' END
    ELSE s[1].role || CASE WHEN len(sec) > 0 THEN '|' || sec[1].role ELSE '' END END AS roles FROM pick""")
def starting_lineups(spark, sf):
    out = starters(spark, sf)
    return r6(out.select("team", "season", "player_id", F.col("pos").cast("int").alias("pos"), "source", F.col("min").alias("mpg"), "lineup_mpg", text("roles")))


@query("season_player_search", f"""WITH {PART}, n AS (SELECT *, {S.SEARCHED} AS h, {UROLES} AS roles FROM feats WHERE season = '1995-96'), {S.name_scores('n', 'smal rng4')}
SELECT player_id, player_name AS name, team, roles[1] AS role, round(pts_per36, 6) AS pts_per36, round("min" / gp, 6) AS mpg, round(score, 6) AS score
FROM n JOIN name_score USING (h) WHERE score >= 35 ORDER BY name_score.score DESC, lower(player_name), player_id LIMIT 8""")
def season_player_search(spark, sf):
    """Misspelt names among one season's rows, with the role each would play in a unit."""
    rows = part_features(spark, sf).select("player_id", "player_name", "team", "season", "pts_per36", "gp", "min", *[f"{m}_z" for m in M])
    return r6(search_season(name_index(rows, scope=("season",)), "Smal  Rng4", "1995-96").select("player_id", "name", "team", "role", "pts_per36", "mpg", "score"))
