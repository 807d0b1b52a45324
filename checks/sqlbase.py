"""SQL building blocks of the oracles, written for DuckDB on the given tables."""

from __future__ import annotations

METRICS = ["pts_per36", "reb_per36", "ast_per36", "blk_per36", "stl_per36", "tov_per36",
           "fg3a_rate", "fta_rate", "ts_pct", "efg_pct", "ast_pct", "mpg"]
KEYS = {"supplier": "l_suppkey", "part": "l_partkey", "customer": "o_custkey"}
NAMES = {
    "supplier": "SELECT s_suppkey AS player_id, s_name AS player_name FROM supplier",
    "customer": "SELECT c_custkey AS player_id, c_name AS player_name FROM customer",
    "part": """SELECT p_partkey AS player_id, upper(split_part(p_name,' ',1)[1]) || split_part(p_name,' ',1)[2:] || ' ' ||
               upper(split_part(p_name,' ',2)[1]) || split_part(p_name,' ',2)[2:] || p_partkey AS player_name FROM part""",
}

LINES = """lines AS (
  SELECT l_orderkey, l_partkey, l_suppkey, o_custkey, c_nationkey AS nation, year(l_shipdate) AS season_start,
    l_quantity AS q, l_returnflag AS rf, l_discount AS d, l_tax AS t, l_linestatus AS ls, l_linenumber AS ln,
    o_orderpriority AS pr, o_orderstatus AS os
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

SUMS = """count(DISTINCT l_orderkey)::DOUBLE AS gp, sum(q)::DOUBLE AS "min", count(*)::DOUBLE AS fga,
    count(*) FILTER (rf <> 'R')::DOUBLE AS fgm, count(*) FILTER (d >= 0.05)::DOUBLE AS fg3a,
    count(*) FILTER (d >= 0.05 AND rf <> 'R')::DOUBLE AS fg3m, count(*) FILTER (t >= 0.04)::DOUBLE AS fta,
    count(*) FILTER (t >= 0.04 AND ls = 'F')::DOUBLE AS ftm, count(*) FILTER (ln = 1)::DOUBLE AS oreb,
    count(*) FILTER (ln IN (2, 3))::DOUBLE AS dreb, count(*) FILTER (ln IN (1, 2, 3))::DOUBLE AS reb,
    count(*) FILTER (pr IN ('1-URGENT', '2-HIGH'))::DOUBLE AS ast, count(*) FILTER (os = 'P')::DOUBLE AS stl,
    count(*) FILTER (q >= 45)::DOUBLE AS blk, count(*) FILTER (rf = 'R')::DOUBLE AS tov,
    count(*) FILTER (rf = 'A')::DOUBLE AS w, count(*) FILTER (rf = 'N')::DOUBLE AS l,
    2.0 * count(*) FILTER (rf <> 'R') + count(*) FILTER (d >= 0.05 AND rf <> 'R')
      + count(*) FILTER (t >= 0.04 AND ls = 'F') AS pts_raw, pts_raw::DOUBLE AS pts"""

LABEL = "season_start::VARCHAR || '-' || lpad(((season_start + 1) % 100)::VARCHAR, 2, '0')"


def box(entity: str = "supplier") -> str:
    """CTEs up to `box`: one row per entity and season with totals, team and bio columns."""
    key = KEYS[entity]
    team = """'T' || (SELECT split_part(p_brand, '#', 2) FROM part WHERE p_partkey = s.player_id)""" if entity == "part" else "n_name"
    return f"""{LINES},
sums AS (SELECT {key} AS player_id, season_start, {SUMS} FROM lines GROUP BY ALL),
nations AS (SELECT {key} AS player_id, season_start, nation,
    row_number() OVER (PARTITION BY {key}, season_start ORDER BY count(*) DESC, nation) AS rn
  FROM lines GROUP BY {key}, season_start, nation),
dim AS ({NAMES[entity]}),
box AS (SELECT s.*, {LABEL.replace('season_start', 's.season_start')} AS season, player_name, {team} AS team,
    ['G','W','B'][s.player_id % 3 + 1] AS position_group, ['PG','SF','C'][s.player_id % 3 + 1] AS position,
    ((66 + s.player_id % 22) // 12)::VARCHAR || '-' || ((66 + s.player_id % 22) % 12)::VARCHAR AS height,
    (66 + s.player_id % 22)::DOUBLE AS inches, (170 + 10 * (s.player_id % 11))::VARCHAR AS weight,
    CASE WHEN s.player_id % 5 = 0 THEN 'Undrafted' ELSE (1990 + s.player_id % 8)::VARCHAR END AS draft_year,
    CASE WHEN s.player_id % 5 = 0 THEN 'Undrafted' ELSE (s.player_id % 60 + 1)::VARCHAR END AS draft_number
  FROM sums s JOIN dim USING (player_id) JOIN nations n ON n.player_id = s.player_id
    AND n.season_start = s.season_start AND n.rn = 1 JOIN nation ON n.nation = n_nationkey)"""


def rates(entity: str = "supplier") -> str:
    return f"""{box(entity)},
tot AS (SELECT season, team, sum(fgm) AS tf, sum("min") AS tm FROM box GROUP BY season, team),
rates AS (SELECT box.*,
    coalesce(pts / nullif("min", 0) * 36.0, pts) AS pts_per36, coalesce(reb / nullif("min", 0) * 36.0, reb) AS reb_per36,
    coalesce(ast / nullif("min", 0) * 36.0, ast) AS ast_per36, coalesce(blk / nullif("min", 0) * 36.0, blk) AS blk_per36,
    coalesce(stl / nullif("min", 0) * 36.0, stl) AS stl_per36, coalesce(tov / nullif("min", 0) * 36.0, tov) AS tov_per36,
    coalesce(fg3a / nullif(fga, 0), 0) AS fg3a_rate, coalesce(fta / nullif(fga, 0), 0) AS fta_rate,
    coalesce(pts / nullif(2.0 * (fga + 0.44 * fta), 0), 0) AS ts_pct, coalesce((fgm + 0.5 * fg3m) / nullif(fga, 0), 0) AS efg_pct,
    greatest(0.0, least(1.0, coalesce(CASE WHEN "min" / nullif(tm / 5.0, 0) * tf - fgm > 0
      THEN ast / ("min" / nullif(tm / 5.0, 0) * tf - fgm) END, 0.0))) AS ast_pct,
    coalesce("min" / nullif(gp, 0), 0) AS mpg
  FROM box JOIN tot USING (season, team))"""


def rounded(v: str) -> str:
    """Ranks are taken on 37 binary digits, so that sums taken in another order still tie."""
    return f"(({v})::DOUBLE * 65537::DOUBLE - (({v})::DOUBLE * 65537::DOUBLE - ({v})::DOUBLE))"


def avg_rank(v: str, part: str = "") -> str:
    v = rounded(v)
    by = f"PARTITION BY {part}" if part else ""
    tie = f"PARTITION BY {part}, {v}" if part else f"PARTITION BY {v}"
    return f"""((rank() OVER ({by} ORDER BY {v}) + rank() OVER ({by} ORDER BY {v}) - 1 + count(*) OVER ({tie}))::DOUBLE / 2.0
      / (count(*) OVER ({by})) * 100.0)"""


def share_le(v: str, part: str = "") -> str:
    v = rounded(v)
    by = f"PARTITION BY {part}" if part else ""
    return f"(cume_dist() OVER ({by} ORDER BY {v}))"


def zscore(v: str, part: str = "", flat: str = "0.0", sd: str = "stddev_pop") -> str:
    by = f"PARTITION BY {part}" if part else ""
    return f"""(CASE WHEN coalesce({sd}({v}) OVER ({by}), 0) > 1e-12
      THEN ({v} - avg({v}) OVER ({by})) / {sd}({v}) OVER ({by}) ELSE {flat} END)"""


def feats(entity: str = "supplier") -> str:
    cols = []
    for m in METRICS:
        cols += [f"{zscore(m, 'season')} AS {m}_z", f"{zscore(m, 'season, position_group')} AS {m}_pos_z",
                 f"{avg_rank(m, 'season')} AS {m}_pctile"]
    return f"{rates(entity)},\nfeats AS (SELECT *, {', '.join(cols)} FROM rates)"


def archetypes(sfx: str = "_z") -> str:
    def a(m, t): return f"{m}{sfx} > {t} + 1e-9"
    def b(m, t): return f"{m}{sfx} < {t} - 1e-9"
    rules = [
        (f"{a('pts_per36', .9)} AND {a('ast_per36', .7)}", "high-volume creator"),
        (f"{a('fg3a_rate', .8)} AND {a('efg_pct', .2)}", "perimeter scorer"),
        (f"{a('fta_rate', .8)} AND {a('pts_per36', .4)}", "free-throw pressure scorer"),
        (f"{a('ast_per36', .8)} AND {b('tov_per36', .5)}", "table setter"),
        (f"{a('efg_pct', .8)} AND {b('pts_per36', .6)}", "efficient finisher"),
        (f"{a('blk_per36', .9)} AND {a('reb_per36', .4)}", "rim protection"),
        (f"{a('stl_per36', .8)} AND {a('fg3a_rate', .2)}", "3-and-D profile"),
        (a("reb_per36", .9), "rebounding defender"),
        (f"{a('stl_per36', .75)} OR {a('blk_per36', .75)}", "event creator"),
    ]
    main = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{v}' END" for c, v in rules) + "], lambda x: x IS NOT NULL)"
    weak = f"""list_filter([CASE WHEN {a('pts_per36', 0)} OR {a('ast_per36', 0)} THEN 'balanced scorer' END,
      CASE WHEN {a('reb_per36', 0)} OR {a('blk_per36', 0)} OR {a('stl_per36', 0)} THEN 'box-score defender' END], lambda x: x IS NOT NULL)"""
    return f"""(CASE WHEN len({main}) > 0 THEN {main}[1:3] WHEN len({weak}) > 0 THEN {weak}
      ELSE ['balanced scorer', 'box-score defender'] END)"""


def _tail(sfx: str, blk_reb: float) -> str:
    def a(m, t): return f"{m}{sfx} > {t} + 1e-9"
    def b(m, t): return f"{m}{sfx} < {t} - 1e-9"
    big = f"(({a('reb_per36', .8)} OR {a('blk_per36', .8)}) AND {b('fg3a_rate', -.6)})"
    return f"""WHEN {a('fg3a_rate', .8)} AND {a('efg_pct', -.5)} THEN 'Perimeter Specialist'
      WHEN {a('fta_rate', .5)} AND {a('pts_per36', 0)} THEN 'Rim Attacker'
      WHEN ({a('stl_per36', .5)} OR {a('blk_per36', .5)}) AND {b('pts_per36', -.2)} THEN 'Defensive Specialist'
      WHEN {big} AND {b('fg3a_rate', -.2)} THEN 'Interior Presence'
      WHEN {a('blk_per36', 1)} AND {a('reb_per36', blk_reb)} AND {b('fg3a_rate', 0)} THEN 'Interior Presence'
      WHEN {big} THEN 'Interior Presence'
      WHEN {a('fg3a_rate', .3)} THEN 'Perimeter Specialist' WHEN {a('ast_per36', 0)} THEN 'Secondary Creator'
      WHEN {a('pts_per36', 0)} THEN 'Rim Attacker' ELSE 'Defensive Specialist' END)"""


def role(sfx: str = "_z") -> str:
    def a(m, t): return f"{m}{sfx} > {t} + 1e-9"
    def b(m, t): return f"{m}{sfx} < {t} - 1e-9"
    return f"""(CASE WHEN {a('ast_per36', 1)} AND {a('ast_pct', .8)} THEN 'Playmaker'
      WHEN {a('pts_per36', 1)} AND {b('ast_pct', .6)} THEN 'Designated Scorer'
      WHEN {a('ast_per36', .3)} AND ({a('pts_per36', .2)} OR {a('ast_pct', .3)}) THEN 'Secondary Creator'
      {_tail(sfx, .8)}"""


def prospect_role(sfx: str) -> str:
    def a(m, t): return f"{m}{sfx} > {t} + 1e-9"
    def b(m, t): return f"{m}{sfx} < {t} - 1e-9"
    big = f"(({a('reb_per36', .8)} OR {a('blk_per36', .8)}) AND {b('fg3a_rate', -.6)})"
    return f"""(CASE WHEN {a('ast_per36', 1)} AND NOT {big} THEN 'Playmaker'
      WHEN {a('pts_per36', .8)} AND {b('ast_per36', .5)} THEN 'Designated Scorer'
      WHEN {a('ast_per36', .3)} THEN 'Secondary Creator' {_tail(sfx, .5)}"""


def impact(sfx: str, trust: str) -> str:
    """Scalar expression over percentile columns <metric><sfx>."""
    def p(m): return f"(0.5 + {trust} * ({m}{sfx} / 100.0 - 0.5))"
    pts, ts, efg, ast, apct, reb, stl, blk, f3, tov = map(p, (
        "pts_per36", "ts_pct", "efg_pct", "ast_per36", "ast_pct", "reb_per36", "stl_per36", "blk_per36", "fg3a_rate", "tov_per36"))
    sc, pm = f"({pts} * (0.55 + 0.45 * {ts}))", f"(0.6 * {ast} + 0.4 * {apct})"
    sp, de = f"({f3} * (0.4 + 0.6 * {efg}))", f"(1.0 - (1.0 - {stl}) * (1.0 - {blk}))"
    cr = f"(0.5 * greatest({sc}, {pm}) + 0.5 * (0.6 * {sc} + 0.4 * {pm}))"
    ln = " + ".join(f"ln(greatest({x}, 1e-3))" for x in (cr, ts, de, reb, sp))
    return f"""(pow(0.32 * {sc} + 0.18 * {pm} + 0.08 * {ts} + 0.09 * {reb} + 0.12 * {stl} + 0.07 * {blk} + 0.08 * {sp}
      + 0.06 * (1.0 - {tov}), 0.72) * pow(exp(({ln}) / 5), 0.28))"""


def scored(entity: str = "supplier") -> str:
    cols = ", ".join(f"coalesce(nullif({m}_pctile, 0), 50.0) AS {m}_q" for m in METRICS)
    return f"""{feats(entity)},
med AS (SELECT *, {cols}, least(1.0, sqrt("min" / 1500.0)) AS trust FROM feats),
pf AS (SELECT *, {impact('_q', 'trust')} AS pfv FROM med),
adj AS (SELECT *, pfv * sqrt(mpg_pctile / 100.0) * pow(least(1.0, sqrt("min" / 4000.0)), 0.25) AS adjusted FROM pf),
scored AS (SELECT *, least(pow(row_number() OVER (PARTITION BY season ORDER BY adjusted, player_id)::DOUBLE
    / count(*) OVER (PARTITION BY season), 1.2) * 0.99, 0.99) AS apfv FROM adj)"""


def mode(col: str, src: str = "feats") -> str:
    return f"""(SELECT player_id, {col} FROM (SELECT player_id, {col}, row_number() OVER (PARTITION BY player_id
      ORDER BY count(*) DESC, {col}) AS rn FROM {src} GROUP BY player_id, {col}) WHERE rn = 1)"""


def careers(entity: str = "supplier") -> str:
    """CTEs up to `career`: rolled-up careers with percentiles and labels."""
    wm = ", ".join(f"""sum(greatest("min", gp * 12.0) * {m}) / sum(greatest("min", gp * 12.0)) AS {m}"""
                   for m in [*[f"{x}_z" for x in METRICS], *METRICS])
    pct = ", ".join([*[f"{avg_rank(m)} AS {m}_global_pctile" for m in METRICS],
                     *[f"{avg_rank('(-tov_per36)' if m == 'tov_per36' else m, 'bucket')} AS {m}_career_pctile" for m in METRICS]])
    return f"""{feats(entity)},
rolled AS (SELECT player_id, max_by(player_name, season) AS player_name, sum(gp)::BIGINT AS career_games,
    sum("min") AS career_minutes, min(season) AS first_season, max(season) AS last_season, max(season_start) AS last_season_start,
    min(position) AS primary_position, min(position_group) AS position_group, min(height) AS height, min(inches) AS inches,
    min(weight) AS weight, min(draft_year) AS draft_year, min(draft_number) AS draft_position, {wm}
  FROM feats GROUP BY player_id),
bucketed AS (SELECT *, CASE WHEN inches <= 0 THEN 'wing' WHEN inches < 76 THEN 'guard' WHEN inches <= 80 THEN 'wing'
    WHEN inches < 84 THEN 'big' ELSE 'center' END AS bucket FROM rolled),
career AS (SELECT *, {pct}, {archetypes()} AS archetypes, {role()} AS role,
    first_season || ' to ' || last_season AS career_span FROM bucketed)"""


def players(entity: str = "supplier") -> str:
    """CTEs up to `player`: careers with caliber."""
    axes = ["pts_per36", "reb_per36", "ast_per36", "blk_per36", "stl_per36", "ts_pct"]
    def q(m): return f"(coalesce(nullif({m}_global_pctile, 0), 50.0) / 100.0)"
    poly = " + ".join(f"{q(a)} * {q(b)}" for a, b in zip(axes, axes[1:] + axes[:1]))
    return f"""{careers(entity)},
poly AS (SELECT *, ({poly}) / 6 * pow({q('mpg')}, 1.5) AS polygon FROM career),
player AS (SELECT *, least(pow({share_le('polygon', 'bucket')}, 1.5) * 0.99, 0.99) AS caliber FROM poly)"""


def r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def common_letters(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts of at most 60 letters: a bit for each letter of a, all set at first."""
    full = f"((1::BIGINT << length({a})) - 1)"
    marks = f"list_transform(string_split({b}, ''), lambda c: coalesce(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN ({a})[i + 1] = c THEN 1::BIGINT << i::INT ELSE 0 END)), 0)::BIGINT)"
    return f"(length({a}) - bit_count(list_reduce(list_concat([{full}], {marks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"


def text_ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {common_letters(a, b)} / (length({a}) + length({b})) END"


def name_scores(rows: str, needle: str) -> str:
    """CTEs up to name_score(h, score) of the searched names h of `rows`."""
    return f"""hs AS (SELECT DISTINCT h, string_split(h, ' ') AS w, '{needle}' AS q, list_distinct(string_split('{needle}', ' ')) AS qw FROM {rows} WHERE h <> ''),
ws AS (SELECT t, {text_ratio("q", "t")} AS ratio FROM (SELECT DISTINCT unnest(w) AS t, q FROM hs)),
best_word AS (SELECT h, max(ratio) AS ratio FROM (SELECT h, unnest(w) AS t FROM hs) JOIN ws USING (t) GROUP BY h),
parts AS (SELECT *, list_sort(list_filter(qw, lambda x: list_contains(w, x))) AS ib, list_sort(list_filter(qw, lambda x: NOT list_contains(w, x))) AS oq,
  list_sort(list_filter(list_distinct(w), lambda x: NOT list_contains(qw, x))) AS oh FROM hs),
joined AS (SELECT *, array_to_string(ib, ' ') AS base, array_to_string(list_concat(ib, oq), ' ') AS x, array_to_string(list_concat(ib, oh), ' ') AS y FROM parts),
name_score AS (SELECT h, (CASE WHEN h = q THEN 120 WHEN list_contains(w, q) THEN 115 WHEN len(list_filter(w, lambda t: starts_with(t, q))) > 0 THEN 110
  WHEN starts_with(h, q) THEN 105 WHEN contains(h, q) THEN 100
  ELSE greatest({text_ratio("q", "h")}, 0.95::DOUBLE * ratio, CASE WHEN len(ib) > 0 AND (len(oq) = 0 OR len(oh) = 0) THEN 100.0::DOUBLE
    ELSE greatest({text_ratio("x", "y")}, CASE WHEN len(ib) > 0 THEN greatest({text_ratio("base", "x")}, {text_ratio("base", "y")}) ELSE 0 END) END) END)::DOUBLE AS score
  FROM joined JOIN best_word USING (h))"""


SEARCHED = "trim(regexp_replace(lower(player_name), '[^a-z0-9]+', ' ', 'g'))"
