"""Ingest and search queries. Landed texts are derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import clean as K
from tallyframe.operators import search
from tallyframe.operators.name_index import name_index, search_index
from tallyframe.session import checkpoint_dir
from tallyframe.sources import landed
from tallyframe.sources.boxscore import names as part_names
from tallyframe.sources.boxscore import table

from . import sqlbase as S
from .views import part_rates, r6, rates, text

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = sql
        return fn
    return add


@query("rowset_json", f"""WITH {S.box()} SELECT player_id, season, gp::BIGINT AS gp, CASE WHEN gp % 2 = 0 THEN pts END AS pts FROM box""")
def rowset_json(spark, sf):
    """One header-and-rows payload per supplier, every odd-games total unreadable."""
    rows = rates(spark, sf)
    cells = F.array(F.col("season"), F.col("gp").cast("string"), F.when(F.col("gp") % 2 == 0, F.col("pts").cast("string")).otherwise("n/a"))
    payload = rows.groupBy("player_id").agg(F.to_json(F.struct(F.array(F.struct(
        F.array(F.lit("SEASON"), F.lit("GP"), F.lit("PTS")).alias("headers"), F.collect_list(cells).alias("rowSet"))).alias("resultSets"))).alias("text"))
    out = landed.rowset_rows(payload, "text", {"SEASON": "string", "GP": "double", "PTS": "double"}, ["player_id"])
    return out.withColumn("gp", F.col("gp").cast("bigint"))


@query("keyed_json", f"""WITH {S.box()} SELECT player_id || ':' || season AS key, gp, team FROM box""")
def keyed_json(spark, sf):
    docs = rates(spark, sf).select(F.to_json(F.create_map(F.concat_ws(":", F.col("player_id").cast("string"), "season"), F.struct("gp", "team"))).alias("value"))
    return landed.keyed_documents(docs, "struct<gp:double,team:string>").select("key", "doc.*")


@query("keyed_json_files", """SELECT 'k"' || l_orderkey || ':' || l_linenumber AS key, l_quantity::BIGINT AS qty, l_returnflag AS mode FROM lineitem""")
def keyed_json_files(spark, sf):
    """Written as keyed files and read back; keys with quotation marks."""
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit('k"'), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("key"),
        F.col("l_quantity").cast("bigint").alias("qty"), F.col("l_returnflag").alias("mode"))
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    landed.write_keyed_json(rows, path, "key")
    return landed.read_keyed_json(spark, path, "struct<qty:bigint,mode:string>").select("key", "doc.*")


@query("stored_tables", """SELECT n_nationkey, n_name, true AS same_types, true AS same_names, false AS other_types, false AS missing FROM nation""")
def stored_tables(spark, sf):
    """A stored table is taken up by names, by names and types, and not with other types or where there is none."""
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name")
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    landed.write_table(rows, path)
    other = T.StructType([T.StructField("n_nationkey", T.StringType()), T.StructField("n_name", T.StringType())])
    facts = {"same_types": landed.read_if_matching(spark, path, rows.schema), "same_names": landed.read_if_matching(spark, path, ["n_name", "n_nationkey"]),
             "other_types": landed.read_if_matching(spark, path, other), "missing": landed.read_if_matching(spark, path + "-none", rows.columns)}
    return facts["same_types"].withColumns({k: F.lit(v is not None) for k, v in facts.items()})


@query("prospect_json", f"""SELECT CASE WHEN s_nationkey % 2 = 0 THEN 2000 + s_nationkey ELSE 2020 END AS class_year, s_suppkey AS id, s_name AS name FROM supplier""")
def prospect_json(spark, sf):
    """Bare lists named by class, wrapped objects without a year in the name; one file text per supplier."""
    rec = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    listed = F.col("s_nationkey") % 2 == 0
    texts = table(spark, sf, "supplier").select(
        F.when(listed, F.concat(F.lit("prospects_"), (2000 + F.col("s_nationkey")).cast("string"), F.lit(".json"))).otherwise("prospects.json").alias("file"),
        F.when(listed, F.to_json(F.array(rec))).otherwise(F.to_json(F.struct(F.lit(2020).alias("draft_class_year"), F.array(rec).alias("prospects")))).alias("value"))
    return landed.prospect_records(texts, "struct<id:bigint,name:string>")


@query("html_tables", f"""WITH {S.box('part')} SELECT player_id || ':' || season AS page, player_name AS "Player", team AS "Team", gp::BIGINT AS gp, '/player/' || player_id AS link FROM box""")
def html_tables(spark, sf):
    """A page per part season: a decoy table, then the stats table."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    name = F.concat(F.lit('<a href="/player/'), F.col("player_id").cast("string"), F.lit('">'), F.col("player_name"), F.lit("</a>"))
    pages = part_rates(spark, sf).select(
        F.concat_ws(":", F.col("player_id").cast("string"), "season").alias("page_id"),
        F.concat(F.lit("<h2>Notes</h2><table><tr><th>Player</th></tr><tr><td>x</td></tr></table><h2>Stats</h2><table><thead><tr><th>Player</th><th>Team</th><th>GP</th></tr></thead><tbody><tr>"),
                 cell(name), cell(F.col("team")), cell(F.col("gp").cast("bigint").cast("string")), F.lit("</tr></tbody></table>")).alias("html"))
    rows = landed.rows_with_headers(landed.table_rows(pages), ["Player", "Team", "GP"], ["Player", "Team", "GP"])
    return rows.select("page", "Player", "Team", K.number(F.col("GP")).cast("bigint").alias("gp"), "link")


@query("page_fields", """WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN html || (2007 + page_id % 90) || '  nba draft' WHEN 1 THEN html || 'NBA Draft ' || (1990 + page_id % 40)
    WHEN 2 THEN html || (2010 + page_id % 9) || ' Draft Prospects' ELSE html END || '<strong>Height:</strong> ' || (5 + page_id % 3) || '-' || (page_id % 12)
    || '<p><strong>College:</strong> <a href="#">Team' || page_id || ' (2019)</a></p>' AS t FROM pages)
SELECT page_id, (5 + page_id % 3) || '-' || (page_id % 12) AS height, 'Team' || page_id AS team, CASE page_id % 4 WHEN 0 THEN 2007 + page_id % 90
  WHEN 1 THEN CASE WHEN 1990 + page_id % 40 >= 2007 THEN 1990 + page_id % 40 END WHEN 2 THEN 2010 + page_id % 9 END::INT AS class_year, length(t)::BIGINT AS n FROM p""")
def page_fields(spark, sf):
    """Regex fields over whole pages with marks appended."""
    i = F.col("page_id")
    num = lambda c: c.cast("string")
    mark = (F.when(i % 4 == 0, F.concat(num(2007 + i % 90), F.lit("  nba draft"))).when(i % 4 == 1, F.concat(F.lit("NBA Draft "), num(1990 + i % 40)))
            .when(i % 4 == 2, F.concat(num(2010 + i % 9), F.lit(" Draft Prospects"))).otherwise(""))
    t = F.concat("html", mark, F.lit("<strong>Height:</strong> "), num(5 + i % 3), F.lit("-"), num(i % 12), F.lit('<p><strong>College:</strong> <a href="#">Team'), num(i), F.lit(" (2019)</a></p>"))
    pages = table(spark, sf, "pages").select("page_id", t.alias("t"))
    return pages.select("page_id", landed.profile_size(F.col("t"))["height"].alias("height"), landed.profile_team(F.col("t")).alias("team"),
                        landed.class_year(F.col("t")).alias("class_year"), F.length("t").cast("bigint").alias("n"))


@query("pre_draft_rows", f"""WITH {S.box()}, c AS (SELECT *, 1996 + player_id % 7 AS dy, season_start // 100 * 100 + (season_start + 1) % 100 AS ey FROM box),
k AS (SELECT *, max(ey) OVER (PARTITION BY player_id) AS best FROM c WHERE ey <= dy), one AS (SELECT * FROM k WHERE ey = best AND "min" / gp <= 50)
SELECT player_id, season, team, ey::INT AS end_year, gp AS games, round("min" / gp, 6) AS minutes FROM one""")
def pre_draft_rows(spark, sf):
    """Season lines twice: under the team and as 'All Teams'; totals and later tables mixed in."""
    base = rates(spark, sf).withColumn("draft_year", (1996 + F.col("player_id") % 7).cast("int"))
    mpg = (F.col("min") / F.col("gp"))
    line = lambda title, team, m: base.select("player_id", "draft_year", F.lit(title).alias("title"), "season", team.alias("team"), F.col("gp").cast("string").alias("gp"), m.cast("string").alias("min"))
    rows = (line("College Stats", F.col("team"), mpg).unionByName(line("College Stats", F.lit("All Teams"), mpg))
            .unionByName(line("College Totals", F.lit("Totals"), F.col("min"))).unionByName(line("NBA Season Stats", F.lit("Pro"), F.lit(10.0))))
    return r6(landed.pre_draft_rows(rows).select("player_id", "season", "team", "end_year", "games", "minutes"))


@query("season_labels", f"""WITH {S.LINES}, y AS (SELECT DISTINCT season_start AS y FROM lines) SELECT y AS season_start, {S.LABEL.replace('season_start', 'y')} AS label,
  (y // 100 * 100 + (y + 1) % 100)::INT AS end_year, (y - 1)::VARCHAR || '-' || lpad((y % 100)::VARCHAR, 2, '0') AS class_season, (y + 1)::INT AS class_year FROM y""")
def season_labels(spark, sf):
    y = F.col("season_start")
    rows = rates(spark, sf).select("season_start").distinct()
    label = K.season_label(y)
    return rows.select("season_start", K.normalize_season(y.cast("string")).alias("label"), K.season_end_year(label).alias("end_year"),
                       K.season_for_class(y).alias("class_season"), K.class_for_season(label).alias("class_year"))


@query("sizes_and_positions", f"""WITH {S.careers('customer').split('career AS')[0].rstrip().rstrip(',')}, d AS (SELECT player_id, inches, weight::DOUBLE AS w, draft_year, position FROM
  (SELECT player_id, min(inches) AS inches, min(weight) AS weight, min(draft_year) AS draft_year, min(position) AS position FROM feats GROUP BY player_id))
SELECT player_id, inches, w AS pounds, draft_year, CASE position WHEN 'PG' THEN 'G' WHEN 'SF' THEN 'W' ELSE 'B' END AS grp,
  CASE WHEN inches < 76 THEN 'guard' WHEN inches <= 80 THEN 'wing' WHEN inches < 84 THEN 'big' ELSE 'center' END AS bucket FROM d""")
def sizes_and_positions(spark, sf):
    """Heights in four notations, long and combined position names."""
    from .views import rolled
    df = rolled(spark, sf, "customer")
    feet, inch = F.split("height", "-")[0], F.split("height", "-")[1]
    k = F.col("player_id") % 4
    shown = F.when(k == 0, F.col("height")).when(k == 1, F.concat(feet, F.lit("'"), inch, F.lit('"'))).when(k == 2, F.concat(feet, F.lit(" / "), inch)).otherwise(
        (feet.cast("int") * 12 + inch.cast("int")).cast("string"))
    pos = F.when(F.col("primary_position") == "PG", "Guard").when(F.col("primary_position") == "SF", " sf-pf ").otherwise("XX-C")
    inches = K.height_inches(shown)
    return df.select("player_id", inches.alias("inches"), K.weight_pounds(F.col("weight")).alias("pounds"), K.draft_value(F.col("draft_year")).alias("draft_year"),
                     K.position_group(pos).alias("grp"), K.height_bucket(inches).alias("bucket"))


_SUB = "CASE WHEN starts_with({t}, 'c12') THEN 100.0 WHEN regexp_matches({t}, 'c.*1.*2') THEN 100.0 * 3 / length(regexp_extract({t}, '^(.*?)(c.*?1.*?2)', 2)) * (1.0 - length(regexp_extract({t}, '^(.*?)(c.*?1.*?2)', 1)) / length({t}) * 0.35) ELSE 0.0 END"


@query("subsequence_search", f"""WITH m AS (SELECT c_custkey AS team_id, lower(c_name) AS name, 'c' || c_custkey AS abbr, lower(c_mktsegment) AS nick FROM customer),
s AS (SELECT team_id, name, greatest(CASE WHEN abbr = 'c12' THEN 100.0 WHEN starts_with(abbr, 'c12') THEN 98.0 ELSE {_SUB.format(t='abbr')} END, {_SUB.format(t='name')}, {_SUB.format(t='nick')}) AS score FROM m)
SELECT team_id, round(score::DOUBLE, 6) AS score FROM s WHERE score >= 35 ORDER BY score DESC, name, team_id LIMIT 6""")
def subsequence_search(spark, sf):
    meta = table(spark, sf, "customer").select(F.col("c_custkey").alias("team_id"), F.col("c_name").alias("name"),
                                               F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("abbreviation"), F.col("c_mktsegment").alias("nickname"))
    return r6(search.search_teams(meta, " C12 ").select("team_id", "score"))


@query("name_search_tiers", f"""WITH dim AS ({S.NAMES['part']}), n AS (SELECT player_id, player_name, lower(player_name) AS h FROM dim)
SELECT player_id, CASE WHEN h = 'ring1' THEN 120.0 WHEN list_contains(string_split(h, ' '), 'ring1') THEN 115.0
  WHEN len(list_filter(string_split(h, ' '), lambda w: starts_with(w, 'ring1'))) > 0 THEN 110.0 WHEN starts_with(h, 'ring1') THEN 105.0 WHEN contains(h, 'ring1') THEN 100.0 END::DOUBLE AS score FROM n
WHERE contains(h, 'ring1')""")
def name_search_tiers(spark, sf):
    names = part_names(spark, sf, "part")
    out = names.withColumn("score", search.tier_score(K.search_name(F.col("player_name")), "ring1"))
    return out.where("score is not null").select("player_id", "score")


@query("fuzzy_name_search", f"""WITH dim AS ({S.NAMES['part']}), n AS (SELECT *, {S.SEARCHED} AS h FROM dim), {S.name_scores('n', 'rde wdget11')}
SELECT player_id, player_name, round(score, 6) AS score FROM n JOIN name_score USING (h) WHERE score >= 35 ORDER BY name_score.score DESC, lower(player_name), player_id LIMIT 8""")
def fuzzy_name_search(spark, sf):
    names = part_names(spark, sf, "part")
    return r6(search_index(name_index(names), "Rde Wdget11"))
