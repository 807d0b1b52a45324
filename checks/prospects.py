"""Prospect queries. Prospects: a supplier's first season per game, classed by its nation. Pool: customer careers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import preset as P
from tallyframe.functions.clean import clean_name, slug
from tallyframe.functions.rates import add_load_axes, prospect_rates
from tallyframe.operators import career as C
from tallyframe.operators import crosspool as X
from tallyframe.operators.upserts import first_per_key
from tallyframe.sources.boxscore import table

from . import sqlbase as S
from .views import careers, r6, rates, similar, stage

Q, O = {}, {}
M = P.METRICS
PM = P.PROSPECT_METRICS
MIN_GAMES = 8
PARAMS = X.CompParams(bandwidth=0.12)


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = sql
        return fn
    return add


def prospects(spark, sf):
    def build():
        first = first_per_key(rates(spark, sf), ["player_id"], [F.col("season_start")])
        nation = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_nationkey").alias("class"))
        pg = lambda c: F.col(c) / F.col("gp")
        out = first.join(nation, "player_id").select(
            F.col("player_id").alias("prospect_id"), "player_name", "class", "team", "height", "weight", "gp", pg("min").alias("mpg"), pg("pts").alias("ppg"),
            *[pg(c).alias(c) for c in ("fgm", "fga", "fg3m", "fg3a", "ftm", "fta")], pg("reb").alias("rpg"), pg("ast").alias("apg"), pg("stl").alias("spg"),
            pg("blk").alias("bpg"), "fg3_pct")
        return prospect_rates(out)
    return stage(spark, sf, "prospects", build)


_P36 = {"pts_per36": "ppg", "ast_per36": "apg", "reb_per36": "rpg", "stl_per36": "spg", "blk_per36": "bpg"}
PROS = f"""{S.box()}, f1 AS (SELECT box.*, s_nationkey AS class, row_number() OVER (PARTITION BY player_id ORDER BY season_start) AS rn
  FROM box JOIN supplier ON s_suppkey = player_id QUALIFY rn = 1),
pg AS (SELECT player_id AS prospect_id, player_name, class, height, inches, weight, gp, "min" / gp AS mpg, pts / gp AS ppg, fgm / gp AS fgm, fga / gp AS fga,
    fg3m / gp AS fg3m, fg3a / gp AS fg3a, fta / gp AS fta, reb / gp AS rpg, ast / gp AS apg, stl / gp AS spg, blk / gp AS bpg FROM f1),
pros AS (SELECT *, {', '.join(f'coalesce({v} / nullif(mpg, 0) * 36.0, 0) AS {k}' for k, v in _P36.items())}, coalesce(fg3a / nullif(fga, 0), 0) AS fg3a_rate,
    coalesce(fta / nullif(fga, 0), 0) AS fta_rate, coalesce(ppg / nullif(2.0 * (fga + 0.44 * fta), 0), 0) AS ts_pct,
    coalesce((fgm + 0.5 * fg3m) / nullif(fga, 0), 0) AS efg_pct, coalesce(apg / nullif(fgm, 0), 0) AS ast_pct,
    CASE WHEN inches <= 0 THEN 'wing' WHEN inches < 76 THEN 'guard' WHEN inches <= 80 THEN 'wing' WHEN inches < 84 THEN 'big' ELSE 'center' END AS bucket FROM pg)"""
DAMP = """(pow(greatest(0.0, least(1.0, mpg / 24.0)), 1.4) * CASE WHEN gp > 0 THEN sqrt(least(1.0, gp / 25.0)) ELSE 1.0 END
  * CASE WHEN ts_pct > 0 THEN least(1.0, ts_pct / 0.60) ELSE 1.0 END)"""


@query("prospect_rates", f"WITH {PROS} SELECT prospect_id, class, {S.r(*[m for m in PM], 'ast_pct')} FROM pros")
def prospect_rate_rows(spark, sf):
    return r6(prospects(spark, sf).select("prospect_id", "class", *PM, "ast_pct"))


# missing axes (ast_pct, tov) count as the median
_PCT = f"""{PROS}, pp AS (SELECT *, {', '.join(f'{S.share_le(m)} * 100.0 AS {m}_pct' for m in PM)}, 50.0 AS ast_pct_pct, 50.0 AS tov_per36_pct FROM pros),
pv AS (SELECT *, {S.impact('_pct', '1.0')} AS pfv FROM pp), ad AS (SELECT *, pfv * {DAMP} AS adjusted FROM pv)"""


@query("prospect_scores", f"""WITH {_PCT} SELECT prospect_id, {S.r('pfv', 'adjusted')},
  round(least(sqrt(pow({S.share_le('adjusted', 'bucket')}, 2.2) * greatest(0.0, least(1.0, adjusted / 0.5))) * 0.99, 0.99), 6) AS apfv FROM ad""")
def prospect_scores(spark, sf):
    return r6(C.prospect_scores(prospects(spark, sf)).select("prospect_id", "pfv", "adjusted", "apfv"))


@query("prospect_roles", f"""WITH {PROS}, z AS (SELECT *, {', '.join(
    f"{S.zscore(m, 'class', f'({m} - avg({m}) OVER (PARTITION BY class))', 'stddev_samp')} AS {m}_cz" for m in PM if m != 'mpg')} FROM pros)
SELECT prospect_id, class, {S.prospect_role('_cz')} AS role FROM z""")
def prospect_roles(spark, sf):
    return C.add_prospect_roles(prospects(spark, sf), ["class"]).select("prospect_id", "class", "role")


_BOX = ["ppg", "rpg", "apg", "spg", "bpg", "mpg", "gp"]


@query("class_box_percentiles", f"WITH {PROS} SELECT prospect_id, class, {', '.join(f'round({S.share_le(b, chr(99) + chr(108) + chr(97) + chr(115) * 2)} * 100.0, 6) AS {b}_class_pct' for b in _BOX)} FROM pros")
def class_box_percentiles(spark, sf):
    out = C.class_box_percentiles(prospects(spark, sf), _BOX, ["class"], "prospect_id")
    return r6(out.select("prospect_id", "class", *[f"{b}_class_pct" for b in _BOX]))


@query("score_against_pool", f"""WITH {_PCT}, half AS (SELECT * FROM ad WHERE prospect_id % 2 = 0),
j AS (SELECT a.prospect_id, a.adjusted, a.bucket, count(h.prospect_id) AS n, count(*) FILTER (h.adjusted <= a.adjusted) AS le, count(*) FILTER (h.adjusted = a.adjusted) AS eq
  FROM ad a LEFT JOIN half h ON a.bucket = h.bucket GROUP BY ALL)
SELECT prospect_id, round(least(pow(CASE WHEN eq > 0 THEN le::DOUBLE / n ELSE (le + 1)::DOUBLE / (n + 1) END, 1.5) * 0.99, 0.99), 6) AS apfv FROM j""")
def score_against_pool(spark, sf):
    """Scores against a stored pool (every other prospect); values the pool lacks count as one more member."""
    scored = stage(spark, sf, "prospect_scored", lambda: C.prospect_scores(prospects(spark, sf)).select("prospect_id", "adjusted", "height_bucket"))
    pool = scored.where("prospect_id % 2 = 0")
    return r6(C.curve_against_pool(scored, pool, "adjusted", "height_bucket", "prospect_id").select("prospect_id", "apfv"))


@query("score_write_back", f"""WITH {_PCT} SELECT prospect_id, round(CASE WHEN prospect_id % 3 = 0 THEN pfv ELSE -1.0 END, 6) AS pfv FROM ad""")
def score_write_back(spark, sf):
    stored = prospects(spark, sf).select("prospect_id", F.lit(-1.0).alias("pfv"), F.lit(-1.0).alias("apfv"))
    fresh = C.prospect_scores(prospects(spark, sf)).where("prospect_id % 3 = 0")
    return r6(C.write_back_scores(stored, fresh).select("prospect_id", "pfv"))


@query("load_axes", f"""WITH {S.rates()} SELECT player_id, season, round(stl_per36 + blk_per36, 6) AS stocks, round(pts_per36 * (1 - ast_pct), 6) AS scoring_load,
  round(ast_per36 + 0.5 * ast_pct, 6) AS playmake_load, round(fg3a_rate * ts_pct, 6) AS perimeter_skill, round(reb_per36 + 2.0 * blk_per36, 6) AS interior_load FROM rates""")
def load_axes(spark, sf):
    return r6(add_load_axes(rates(spark, sf)).select("player_id", "season", "stocks", "scoring_load", "playmake_load", "perimeter_skill", "interior_load"))


# ---- comps -----------------------------------------------------------------------------------
def inputs(spark, sf):
    q, p = X.prepare(prospects(spark, sf), careers(spark, sf, "customer"), similar(spark, sf, "customer"), PARAMS, MIN_GAMES)
    return (stage(spark, sf, "comp_queries", lambda: q), stage(spark, sf, "comp_pool", lambda: p, X.GROUP_BYTES))


def top_comps(spark, sf):
    return stage(spark, sf, "top_comps", lambda: X.ranked_comps(*inputs(spark, sf), PARAMS))


def _quality(axes_suffix: str, tail: str) -> str:
    ax = P.SKILL_AXES
    return "((" + " + ".join(f"{a}{axes_suffix} / 100.0 * ({b}{axes_suffix} / 100.0)" for a, b in zip(ax, ax[1:] + ax[:1])) + f") / 6 * {tail})"


def _comps_sql() -> str:
    F_ = P.COMP_FEATURES
    stored = [f for f in F_ if f in M]
    from .players import similar_sql
    loads = "stl_per36 + blk_per36 AS stocks, pts_per36 * (1.0 - greatest(0.0, least(1.0, ast_pct))) AS scoring_load"
    pw, zw = P.COMP_PERCENTILE_WEIGHTS, P.COMP_ZSCORE_WEIGHTS
    pool_parts = [f"{f}_global_pctile / 100.0 * {w}" if f in stored else f"{S.share_le(f)} * {w}" for f, w in zip(F_, pw)]
    pool_parts += [f"({f} - avg({f}) OVER ()) / greatest(stddev_pop({f}) OVER (), 1e-9) * 0.25 * {w}" for f, w in zip(F_, zw)]
    q_parts = [f"{S.share_le(f, 'class')} * {w}" for f, w in zip(F_, pw)]
    q_parts += [f"({f} - avg({f}) OVER (PARTITION BY class)) / greatest(stddev_pop({f}) OVER (PARTITION BY class), 1e-9) * 0.25 * {w}" for f, w in zip(F_, zw)]
    wh, ww = P.COMP_SIZE_WEIGHTS
    k = f"exp(-(pow(list_distance(q.vec, {{v}}.vec), 2) + pow((q.h - {{v}}.h) / q.sd_h * {wh}, 2) + pow((q.w - {{v}}.w) / q.sd_w * {ww}, 2)) / (2.0 * {PARAMS.bandwidth} * {PARAMS.bandwidth}))"
    return f"""{S.players('customer')},
{similar_sql('player', '_global_pctile', '', 'inches', 'player_id', '')},
{PROS.replace(S.LINES + ',', '').strip().replace('sums AS', 'sums_p AS').replace('FROM sums s', 'FROM sums_p s').replace('nations AS', 'nations_p AS').replace('JOIN nations n', 'JOIN nations_p n').replace('dim AS', 'dim_p AS').replace('JOIN dim USING', 'JOIN dim_p USING').replace('box AS (', 'box_p AS (').replace('SELECT box.*, s_nationkey', 'SELECT box_p.*, s_nationkey').replace('FROM box JOIN supplier', 'FROM box_p JOIN supplier')},
pl AS (SELECT *, {loads}, inches AS h0, weight::DOUBLE AS w0, {_quality('_global_pctile', 'pow(mpg_global_pctile / 100.0, 1.5)')} AS qadj FROM career WHERE career_games >= {MIN_GAMES}),
pl2 AS (SELECT *, least(pow({S.share_le('qadj')}, 1.5) * 0.99, 0.99) AS quality, least(pow({S.share_le('qadj', 'bucket')}, 1.5) * 0.99, 0.99) AS rq, pts_per36 * mpg / 36.0 AS ppg FROM pl),
pl3 AS (SELECT *, [{', '.join(pool_parts)}] AS vec, h0 AS h, w0 AS w, {S.avg_rank('ppg')} / 100.0 AS scoring,
  0.35 + 0.65 * (0.5 * {S.share_le('career_minutes')} + 0.5 * {S.share_le('rq')}) AS prior FROM pl2),
qa AS (SELECT *, {loads}, ppg AS ppg0, {', '.join(f"{S.share_le(m, 'class')} * 100.0 AS {m}_q" for m in P.SKILL_AXES)} FROM pros),
qb AS (SELECT *, {_quality('_q', DAMP)} AS qadj FROM qa),
qc AS (SELECT *, least(pow({S.share_le('qadj', 'class')}, 1.5) * 0.99, 0.99) AS quality, pts_per36 * mpg / 36.0 AS ppg1 FROM qb),
sds AS (SELECT c.class, stddev_pop(h) AS sd_h, stddev_pop(w) AS sd_w FROM (SELECT class, inches AS h, weight::DOUBLE AS w FROM qc
  UNION ALL SELECT class, h, w FROM pl3, (SELECT DISTINCT class FROM qc)) c GROUP BY c.class),
q AS (SELECT qd.*, sd_h, sd_w FROM (SELECT *, [{', '.join(q_parts)}] AS vec, inches AS h, weight::DOUBLE AS w, {S.avg_rank('ppg1', 'class')} / 100.0 AS scoring FROM qc) qd JOIN sds USING (class)),
nb AS (SELECT t.player_id, p.vec, p.h, p.w FROM top t JOIN pl3 p ON p.player_id = t.similar_id WHERE t.rank <= 7),
deg AS (SELECT player_id, count(*) AS d FROM nb GROUP BY 1),
nb2 AS (SELECT * FROM nb UNION ALL SELECT p.player_id, vec, h, w FROM pl3 p LEFT JOIN deg USING (player_id) WHERE coalesce(d, 0) < (SELECT max(d) FROM deg)),
nbest AS (SELECT q.prospect_id, n.player_id, max({k.format(v='n')}) AS best FROM q, nb2 n GROUP BY 1, 2),
sc AS (SELECT q.prospect_id, q.class, q.scoring AS qs, p.player_id, p.prior, p.scoring AS ps, 0.65 * {k.format(v='p')} + 0.35 * best AS score
  FROM q, pl3 p JOIN nbest b ON b.player_id = p.player_id WHERE b.prospect_id = q.prospect_id),
pop AS (SELECT *, avg(score) OVER (PARTITION BY class, player_id) AS pop FROM sc),
rs AS (SELECT *, score * (1.0 - pop) * prior * exp(-greatest(0.0, qs - ps) / 0.20) AS rank_score FROM pop),
comps AS (SELECT *, row_number() OVER (PARTITION BY class, prospect_id ORDER BY rank_score DESC, player_id) AS rank FROM rs QUALIFY rank <= 40)"""


COMPS_SQL = _comps_sql()


@query("ranked_comps", f"WITH {COMPS_SQL} SELECT prospect_id, class, player_id, rank, {S.r('score', 'rank_score')} FROM comps")
def ranked_comps(spark, sf):
    return r6(top_comps(spark, sf))


@query("diverse_comps")
def diverse_comps(spark, sf):
    """Four comps per prospect under the era and usage rules, in display order."""
    from tallyframe.functions.clean import career_era
    pool = careers(spark, sf, "customer")
    ranked = top_comps(spark, sf).join(pool.select("player_id", career_era(F.col("career_span")).alias("era")), "player_id")
    picks = X.pick_diverse(ranked, query="prospect_id", item="player_id")
    shown = X.display_order(picks, pool, PARAMS.similarity_gamma)
    return r6(shown.select("prospect_id", "class", "player_id", "place", "similarity_score"))


@query("comp_points", f"""WITH {COMPS_SQL}, truth AS (SELECT DISTINCT prospect_id, (prospect_id * 7) % (SELECT count(*) FROM customer) AS counterpart_id FROM pros),
b AS (SELECT t.prospect_id, counterpart_id, player_id, rank FROM comps c JOIN truth t USING (prospect_id)),
hit AS (SELECT prospect_id, rank AS tr FROM b WHERE player_id = counterpart_id),
lk AS (SELECT b.prospect_id, count(*) AS links FROM b JOIN top e ON e.player_id = b.player_id AND e.similar_id = b.counterpart_id AND e.rank <= 7 WHERE b.rank <= 7 GROUP BY 1)
SELECT sum(2 * coalesce(tr <= 7, false)::INT + coalesce(links, 0))::BIGINT AS points, round(avg(coalesce(tr <= 7, false)::INT), 6) AS recall,
  round(quantile_cont(tr, 0.5), 6) AS median_rank, count(*) AS prospects FROM truth LEFT JOIN hit USING (prospect_id) LEFT JOIN lk USING (prospect_id)""")
def comp_points(spark, sf):
    """Comparison quality against made-up counterparts."""
    n = table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n"))
    from tallyframe.operators.attach import attach_row
    truth = attach_row(prospects(spark, sf).select("prospect_id"), n).select("prospect_id", (F.col("prospect_id") * 7 % F.col("n")).alias("counterpart_id"))
    return r6(X.comp_points(top_comps(spark, sf), truth, similar(spark, sf, "customer")))


@query("pool_cosine_vectors", f"""WITH {S.careers()}, z AS (SELECT player_id, [{', '.join(S.zscore(m) for m in M)}] AS v FROM career)
SELECT player_id, {', '.join(f'round(v[{i + 1}] / sqrt(list_inner_product(v, v)), 6) AS u{i}' for i in range(12))} FROM z""")
def pool_cosine_vectors(spark, sf):
    """Unit vectors whose dot product is the cross-pool cosine."""
    mine = careers(spark, sf).select("player_id", *M)
    unit, _ = X.cross_pool_cosine(mine, careers(spark, sf, "customer").select("player_id", *M), M)
    return r6(unit.select("player_id", *[F.col("unit")[i].alias(f"u{i}") for i in range(12)]))


def _directions(entity: str, name: str) -> str:
    """Unit vectors of one pool as a derived table."""
    return f"""(WITH {S.careers(entity)}, z AS (SELECT player_id, [{', '.join(S.zscore(m) for m in M)}] AS v FROM career)
SELECT player_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM z) {name}"""


@query("pool_cosines", f"""WITH pair AS (SELECT a.player_id, b.player_id AS similar_id, list_inner_product(a.u, b.u) AS cosine FROM {_directions('supplier', 'a')}, {_directions('customer', 'b')})
SELECT player_id, row_number() OVER (PARTITION BY player_id ORDER BY cosine DESC, similar_id) AS rank, similar_id, round(cosine, 6) AS cosine FROM pair
QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY cosine DESC, similar_id) <= 10""")
def pool_cosines(spark, sf):
    """Every supplier career's ten customer careers of greatest cosine."""
    mine, theirs = (careers(spark, sf, e).select("player_id", *M) for e in ("supplier", "customer"))
    return r6(X.cosine_neighbours(mine, theirs, M))


@query("clean_names", """SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[.,]', '', 'g')), '\\s+', ' ', 'g'))) AS cleaned,
  md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS searched,
  md5(CASE WHEN regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN 'unknown'
    ELSE regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END) AS slug FROM documents""")
def clean_names(spark, sf):
    """Name normalizers over whole documents: accents, punctuation, spaces, slugs."""
    from tallyframe.functions.clean import search_name
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(clean_name(F.col("text"))).alias("cleaned"), F.md5(search_name(F.col("text"))).alias("searched"), F.md5(slug(F.col("text"))).alias("slug"))


# ---- projection ------------------------------------------------------------------------------
def projected(spark, sf):
    from tallyframe.operators import projection as J
    from .views import features

    def build():
        asked = C.add_prospect_roles(prospects(spark, sf), ["class"]).withColumn("class_year", (1996 + F.col("class") % 9).cast("int"))
        model = J.fit(J.training_pairs(asked, features(spark, sf)))
        best = top_comps(spark, sf).where("rank = 1").select("prospect_id", F.col("player_id").alias("counterpart_id"), F.lit("").alias("counterpart_name"))
        return J.season_rows(asked, features(spark, sf), model, best)
    return stage(spark, sf, "projected", build)


@query("projection_inputs", f"""WITH {PROS} SELECT prospect_id, {', '.join(f'round(greatest({lo}, least({hi}, {k})), 6) AS x_{k}' for k, (lo, hi) in P.PROJECTION_INPUT_RANGES.items()
    if k in PM)}, round(greatest(0, least(1.6, apg / fgm)), 6) AS x_ast_pct_college, inches AS x_height_in, weight::DOUBLE AS x_weight FROM pros""")
def projection_input_rows(spark, sf):
    from tallyframe.functions.rates import projection_inputs
    out = projection_inputs(prospects(spark, sf))
    return r6(out.select("prospect_id", *[f"x_{k}" for k in P.PROJECTION_INPUT_RANGES if k in PM], "x_ast_pct_college", "x_height_in", "x_weight"))


@query("projected_rows")
def projected_rows(spark, sf):
    return r6(projected(spark, sf).select("player_id", "prospect_id", "season", "position_group", "counterpart_id", "min", "pts", "fga", *M, *[f"{m}_pctile" for m in M]))


@query("combined_rows", f"""WITH {S.feats()} SELECT season, count(*) AS rows, 0::BIGINT AS prospects FROM feats GROUP BY season""")
def combined_rows(spark, sf):
    """Real rows keep their mark when projected rows of other seasons join them."""
    from tallyframe.operators.upserts import combine_rows
    from .views import features
    both = combine_rows(features(spark, sf), projected(spark, sf).select("player_id", "player_name", "season", "is_prospect", *M))
    real = both.where("not is_prospect")
    return real.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("is_prospect").cast("bigint")).alias("prospects"))
