"""Team queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import preset as P
from tallyframe.functions.clean import is_valid_era, normalize_era
from tallyframe.operators import pairs, teams as T
from tallyframe.operators.upserts import keyed_upsert, known_keys, partial_upsert, replace_slices

from . import sqlbase as S
from .views import normalized_teams, part_rates, r6, stage, teams, text

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = sql
        return fn
    return add


TEAM = f"""{S.LINES},
tb AS (SELECT split_part(p_brand, '#', 2)::INT AS team_id, season_start, {S.SUMS} FROM lines JOIN part ON l_partkey = p_partkey GROUP BY ALL),
team AS (SELECT team_id, 'Team ' || team_id AS team_name, {S.LABEL} AS season, season_start, w, l, w / nullif(w + l, 0) AS w_pct, gp,
    fga / nullif("min", 0) * 1000.0 AS pace, pts / nullif(fga, 0) * 100.0 AS off_rating, w / nullif(fga, 0) * 100.0 AS def_rating,
    pts / nullif(2.0 * (fga + 0.44 * fta), 0) AS ts_pct, (fgm + 0.5 * fg3m) / nullif(fga, 0) AS efg_pct, ast / nullif(fgm, 0) AS ast_pct,
    ast / nullif(tov, 0) AS ast_to, tov / nullif(fga, 0) AS tm_tov_pct, oreb / nullif(gp, 0) AS oreb_pct, dreb / nullif(gp, 0) AS dreb_pct,
    reb / nullif(gp, 0) AS reb_pct, fg3a, coalesce(fg3m / nullif(fg3a, 0), 0) AS fg3_pct, fga - fg3a AS paint_fga, fta, fga,
    fta / nullif(fga, 0) AS fta_rate FROM tb)"""
TF = P.TEAM_FEATURES
NORM = f"""{TEAM},
norm AS (SELECT *, {', '.join(f"coalesce({S.zscore(f, 'season', f'({f} - avg({f}) OVER (PARTITION BY season))')}, 0) AS {f}_z" for f in TF)} FROM team)"""


@query("team_seasons", f"""WITH {TEAM} SELECT team_id, team_name, season, w, l, gp, {S.r('w_pct', *[f for f in TF], 'efg_pct', 'reb_pct')} FROM team""")
def team_seasons(spark, sf):
    return r6(teams(spark, sf).select("team_id", "team_name", "season", "w", "l", "gp", "w_pct", *TF, "efg_pct", "reb_pct"))


@query("team_normalized", f"WITH {NORM} SELECT team_id, season, {S.r(*[f'{f}_z' for f in TF])} FROM norm")
def team_normalized(spark, sf):
    return r6(normalized_teams(spark, sf).select("team_id", "season", *[f"{f}_z" for f in TF]))


@query("team_style", f"""WITH {TEAM} SELECT team_id, season, {', '.join(
    f"round({S.avg_rank(c if sign > 0 else f'(-{c})', 'season')}, 6) AS style_{a}" for a, (c, sign) in P.STYLE_AXES.items())} FROM team""")
def team_style(spark, sf):
    return r6(T.style_vectors(teams(spark, sf)).select("team_id", "season", *[f"style_{a}" for a in P.STYLE_AXES]))


def _gt(f, t): return f"{f}_z > {t} + 1e-9"
def _ge(f, t): return f"{f}_z >= {t} - 1e-9"
def _lt(f, t): return f"{f}_z < {t} - 1e-9"


_MOVE = f"(({_gt('ast_pct', .5)} AND {_gt('ast_to', .2)}) OR ({_ge('ast_to', .85)} AND {_gt('ast_pct', -.15)}))"
_RULES = [
    (_gt("pace", .65), "run_and_gun"),
    (f"({_ge('fg3a', .55)} AND {_gt('fg3_pct', -.2)}) OR ({_ge('fg3a', .4)} AND {_gt('fg3_pct', .08)}) OR ({_ge('fg3a', .25)} AND {_gt('fg3_pct', .4)})", "deep_threat"),
    (f"{_gt('paint_fga', .55)} AND {_lt('fg3a', .35)}", "paint_punishers"),
    ("-def_rating_z > 0.65 + 1e-9", "defensive_wall"),
    (f"({_gt('ast_pct', .58)} AND -tm_tov_pct_z > 0.28 + 1e-9) OR ({_gt('ast_pct', .9)} AND {_gt('ast_to', .85)} AND {_lt('tm_tov_pct', .75)})", "playmakers"),
    (_lt("pace", -.65), "grind_it_out"), (_gt("oreb_pct", .7), "glass_eaters"), (_gt("fta_rate", .7), "foul_magnets"),
    (_MOVE, "ball_movement"),
    (f"{_lt('ast_pct', -.45)} AND {_gt('off_rating', .35)} AND {_lt('ast_to', .4)} AND NOT {_MOVE}", "iso_kings"),
]
BADGED = f"""{NORM}, badged AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {c} THEN '{b}' END" for c, b in _RULES)}], lambda x: x IS NOT NULL) AS badges FROM norm)"""


@query("team_badges", f"WITH {BADGED} SELECT team_id, season, array_to_string(badges, '|') AS badges FROM badged")
def team_badges(spark, sf):
    return T.with_badges(normalized_teams(spark, sf)).select("team_id", "season", text("badges"))


_EX = """CASE badge WHEN 'run_and_gun' THEN pace_z
  WHEN 'deep_threat' THEN greatest(fg3a_z + greatest(0.0, fg3_pct_z + 0.20), fg3a_z + fg3_pct_z, fg3a_z * 0.5 + fg3_pct_z * 1.5)
  WHEN 'paint_punishers' THEN paint_fga_z - fg3a_z WHEN 'defensive_wall' THEN -def_rating_z WHEN 'playmakers' THEN ast_pct_z - tm_tov_pct_z
  WHEN 'grind_it_out' THEN -pace_z WHEN 'glass_eaters' THEN oreb_pct_z WHEN 'foul_magnets' THEN fta_rate_z
  WHEN 'iso_kings' THEN off_rating_z - ast_pct_z ELSE ast_pct_z + ast_to_z END"""


@query("badge_leaders", f"""WITH {BADGED}, ex AS (SELECT *, unnest(badges) AS badge FROM badged), sc AS (SELECT *, {_EX} AS ex FROM ex),
rk AS (SELECT *, row_number() OVER (PARTITION BY season, badge ORDER BY ex DESC, team_id) AS rn FROM sc),
grid AS (SELECT season, unnest({P.BADGES!r}) AS badge FROM (SELECT DISTINCT season FROM norm))
SELECT season, badge, a.team_id AS top_team_id, a.w::BIGINT || '-' || a.l::BIGINT AS top_record,
  round(100.0 / (1.0 + exp(-a.ex)), 6) AS top_score, b.team_id AS runner_up_team_id, round(100.0 / (1.0 + exp(-b.ex)), 6) AS runner_up_score
FROM grid LEFT JOIN (SELECT * FROM rk WHERE rn = 1) a USING (season, badge) LEFT JOIN (SELECT * FROM rk WHERE rn = 2) b USING (season, badge)""")
def badge_leaders(spark, sf):
    return r6(T.badge_leaders(normalized_teams(spark, sf)).select(
        "season", "badge", "top_team_id", "top_record", "top_score", "runner_up_team_id", "runner_up_score"))


_TV = "[" + ", ".join(f"greatest(-80.0, least(80.0, {f}_z))" for f in P.TEAM_NEIGHBOUR_FEATURES) + "]"


def _similar(era: bool) -> str:
    part = "a.team_id, a.season" + (", b.season_start // 10" if era else "")
    return f"""{NORM}, v AS (SELECT *, {_TV} AS vec FROM norm),
p AS (SELECT a.team_id || ':' || a.season AS key, b.team_id || ':' || b.season AS similar_key, (b.season_start // 10 * 10) || 's' AS era,
    list_distance(a.vec, b.vec) AS distance, row_number() OVER (PARTITION BY {part}
      ORDER BY list_distance(a.vec, b.vec), b.team_id || ':' || b.season) AS rank
  FROM v a JOIN v b ON a.team_id <> b.team_id AND a.season <> b.season QUALIFY rank <= 6)"""


def near_teams(spark, sf):
    return stage(spark, sf, "near_teams", lambda: pairs.similar_teams(normalized_teams(spark, sf)))


@query("similar_teams", f"WITH {_similar(False)} SELECT key, similar_key, rank, round(distance, 6) AS distance, round(100 / (1 + distance), 6) AS similarity_pct FROM p")
def similar_teams(spark, sf):
    return r6(near_teams(spark, sf).drop("era"))


@query("similar_teams_by_era", f"WITH {_similar(True)} SELECT key, era, similar_key, rank, round(distance, 6) AS distance FROM p")
def similar_teams_by_era(spark, sf):
    return r6(pairs.similar_teams(normalized_teams(spark, sf), by_era=True).drop("similarity_pct"))


_PG = ", ".join(f'coalesce({c} / nullif(gp, 0), 0) AS {c}' for c in ("pts", "ast", "reb", "stl", "blk", "fg3a"))
_ROSTER = f"""{S.box('part')}, roster AS (SELECT player_id, season, team, gp, coalesce("min" / nullif(gp, 0), 0) AS mpg, {_PG},
    coalesce(fg3m / nullif(box.fg3a, 0), 0) AS fg3_pct FROM box)"""
_LEAD = ", ".join(f"arg_max(player_id, ({{'v': {s}, 'i': -player_id}})) AS {s}_leader, round(max({s}), 6) AS {s}_value" for s in T.VOLUME_STATS)
LEADERS = f"""{_ROSTER}, tiers AS (SELECT *, CASE WHEN gp >= 8 AND mpg >= 12 AND fg3a >= 3 THEN 0 WHEN gp >= 5 AND mpg >= 10 AND fg3a >= 2 THEN 1
    WHEN gp >= 3 AND mpg >= 8 AND fg3a >= 1.5 THEN 2 WHEN fg3a >= 1 THEN 3 ELSE 4 END AS tier FROM roster),
best AS (SELECT team, season, min(tier) AS tier FROM tiers GROUP BY ALL),
acc AS (SELECT team, season, arg_max(player_id, ({{'v': fg3_pct, 'i': -player_id}})) AS fg3_pct_leader, round(max(fg3_pct), 6) AS fg3_pct_value,
    min(tier) AS fg3_pct_tier FROM tiers JOIN best USING (team, season, tier) GROUP BY ALL),
lead AS (SELECT team, season, {_LEAD} FROM roster GROUP BY ALL)"""


@query("stat_leaders", f"WITH {LEADERS} SELECT * FROM lead JOIN acc USING (team, season)")
def stat_leaders(spark, sf):
    return r6(T.stat_leaders(T.per_game(part_rates(spark, sf))))


@query("team_profiles", f"""WITH {BADGED.replace(S.LINES + ',', S.LINES + ',', 1)}, st AS (SELECT team_id, season, {', '.join(
    f"{S.avg_rank(c if sign > 0 else f'(-{c})', 'season')} AS style_{a}" for a, (c, sign) in P.STYLE_AXES.items())} FROM team),
v AS (SELECT *, {_TV} AS vec FROM norm),
p AS (SELECT a.team_id, a.season, b.team_id || ':' || b.season AS sk, row_number() OVER (PARTITION BY a.team_id, a.season
    ORDER BY list_distance(a.vec, b.vec), b.team_id || ':' || b.season) AS rn
  FROM v a JOIN v b ON a.team_id <> b.team_id AND a.season <> b.season QUALIFY rn <= 6),
s AS (SELECT team_id, season, string_agg(sk, '|' ORDER BY rn) AS similar_keys FROM p GROUP BY ALL)
SELECT team_id, season, team_name, w::BIGINT || '-' || l::BIGINT AS record, round(w_pct, 6) AS win_pct, array_to_string(badges, '|') AS badges,
  {S.r(*[f'style_{a}' for a in P.STYLE_AXES])}, similar_keys FROM badged JOIN st USING (team_id, season) JOIN s USING (team_id, season)""")
def team_profiles(spark, sf):
    base = teams(spark, sf)
    leaders = T.stat_leaders(T.per_game(part_rates(spark, sf))).withColumn(
        "team_id", F.substring("team", 2, 10).cast("int")).drop("team")
    out = T.team_profiles(base, normalized_teams(spark, sf), near_teams(spark, sf), leaders)
    return r6(out.select("team_id", "season", "team_name", "record", "win_pct", text("badges"), *[f"style_{a}" for a in P.STYLE_AXES],
                         F.array_join(F.transform("similar", lambda x: x["similar_key"]), "|").alias("similar_keys")))


@query("season_readiness", f"""WITH {TEAM} SELECT season, count(*) AS teams, CASE WHEN count(*) >= 25 THEN min(gp) END AS lowest,
  (count(*) >= 25 AND min(gp) >= 10)::INT AS ready FROM team GROUP BY season""")
def season_readiness(spark, sf):
    out = T.season_ready(teams(spark, sf), min_teams=25)
    return out.withColumn("ready", F.coalesce("ready", F.lit(False)).cast("int"))


@query("season_index", f"""WITH {TEAM} SELECT team_id, string_agg(season, '|' ORDER BY season) AS seasons FROM team GROUP BY team_id""")
def season_index(spark, sf):
    return T.season_index(teams(spark, sf)).select("team_id", text("seasons"))


@query("refreshed_seasons", f"""WITH {TEAM} SELECT team_id, season, CASE WHEN season = '2001-02' THEN gp + 1 ELSE gp END AS gp,
  (season = '2001-02')::INT AS fresh FROM team""")
def refreshed_seasons(spark, sf):
    """Incremental refresh: the newest season is replaced by a fresh load, the rest is kept."""
    old = teams(spark, sf).select("team_id", "season", "gp", F.lit(0).alias("fresh"))
    new = old.where("season = '2001-02'").withColumns({"gp": F.col("gp") + 1, "fresh": F.lit(1)})
    return replace_slices(old, new, ["season"])


@query("event_upsert", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
d AS (SELECT user_id, event_type, event_id, round(value, 6) AS value FROM e WHERE rn = 1)
SELECT user_id, event_type, event_id, value, (event_type = 'click')::INT AS fresh FROM d""")
def event_upsert(spark, sf):
    """Latest event per user and type: clicks arrive as a newer batch and win over stored rows."""
    from tallyframe.sources.boxscore import table
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    latest = T.first_per_key(events, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    stored = latest.withColumn("fresh", F.lit(0)).withColumn("value", F.when(F.col("event_type") == "click", -1.0).otherwise(F.col("value")))
    fresh = latest.where("event_type = 'click'").withColumn("fresh", F.lit(1))
    return r6(keyed_upsert(stored, fresh, ["user_id", "event_type"]).drop("ts"))


@query("profile_upsert", f"""WITH {TEAM} SELECT team_id, season, w::BIGINT || '-' || l::BIGINT AS record,
  CASE WHEN season = '2001-02' THEN 'fresh' ELSE 'stored' END AS leaders FROM team WHERE season = '2001-02' OR team_id % 3 <> 0""")
def profile_upsert(spark, sf):
    """Static columns rebuilt for all keys, leaders kept unless fresh, keys without leaders dropped."""
    base = teams(spark, sf).select("team_id", "season", T.record().alias("record"))
    stored = base.where("team_id % 3 <> 0").select("team_id", "season", F.lit("stored").alias("leaders"))
    fresh = base.where("season = '2001-02'").select("team_id", "season", F.lit("fresh").alias("leaders"))
    return partial_upsert(base, stored, fresh, ["team_id", "season"], "leaders")


@query("known_team_keys", f"""WITH {TEAM} SELECT DISTINCT team_id, season, team_id || ':' || season AS key, season_start,
  (season_start = max(season_start) OVER ())::INT AS latest FROM team""")
def known_team_keys(spark, sf):
    return known_keys(teams(spark, sf)).withColumn("latest", F.col("latest").cast("int"))


@query("era_labels", f"""WITH {S.LINES}, y AS (SELECT DISTINCT season_start AS y FROM lines), e AS (SELECT y,
    CASE y % 3 WHEN 0 THEN ((y // 10 * 10) % 100)::VARCHAR WHEN 1 THEN upper(lpad(((y // 10 * 10) % 100)::VARCHAR, 2, '0')) || 'S' ELSE (y // 10 * 10) || 's ' END AS raw FROM y)
SELECT y AS season_start, raw, CASE WHEN raw = '0' THEN '0s' ELSE (y // 10 * 10) || 's' END AS era, (raw <> '0')::INT AS valid FROM e""")
def era_labels(spark, sf):
    y = F.col("season_start")
    decade = F.floor(y / 10) * 10
    short = F.pmod(decade, F.lit(100)).cast("string")
    raw = F.when(y % 3 == 0, short).when(y % 3 == 1, F.concat(F.lpad(short, 2, "0"), F.lit("S"))).otherwise(F.concat(decade.cast("string"), F.lit("s ")))
    rows = teams(spark, sf).select("season_start").distinct().select("season_start", raw.alias("raw"))
    return rows.withColumns({"era": normalize_era(F.col("raw")), "valid": is_valid_era(F.col("raw")).cast("int")})
