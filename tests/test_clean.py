import pytest
from pyspark.sql import functions as F

from tallyframe.functions import clean as K
from tallyframe.functions import rules, scores
from tallyframe.operators import career as C
from tallyframe.operators.upserts import combine_rows, keyed_upsert, partial_upsert


def one(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_heights_weights_drafts(spark):
    assert one(spark, K.height_inches, ["6-7", "6'7\"", "6/7", "78", "", None, "tall"]) == [79.0, 79.0, 79.0, 78.0, 0.0, 0.0, 0.0]
    assert one(spark, lambda c: K.height_inches(c, 78.0), ["", None]) == [78.0, 78.0]
    assert one(spark, K.weight_pounds, ["215", "heavy", None]) == [215.0, 220.0, 220.0]
    assert one(spark, K.draft_value, ["Undrafted", "NaN", "12.0", "7", "", None, "x"]) == ["Undrafted", "Undrafted", "12", "7", None, None, "x"]


def test_positions(spark):
    assert one(spark, K.position_group, ["Guard", "Forward-Guard", "C-F", "xx-C", "", None, "PG-SG", "sf"]) == ["G", "W", "B", "B", "W", "W", "G", "W"]


def test_seasons(spark):
    assert one(spark, K.normalize_season, ["2024-25", "1999", "x", "24-25"]) == ["2024-25", "1999-00", None, None]
    assert one(spark, K.season_end_year, ["2004-05", "1999-00", "2004-2005", "2010", "Career"]) == [2005, 1900, 2005, 2010, None]
    assert one(spark, K.normalize_era, ["90", "10S", "2020s ", "80s"]) == ["1990s", "2010s", "2020s", "80s"]
    assert one(spark, K.career_era, ["1996-97 to 1998-99", "2020-21", "junk"]) == ["late-90s", "late-2010s", "2010s"]


def test_names_and_labels(spark):
    assert one(spark, K.clean_name, ["Nikola Jokić", "J.R.  Smith, Jr."]) == ["nikola jokic", "jr smith jr"]
    assert one(spark, K.match_name, ["Luka Dončić!"]) == ["luka doncic"]
    assert one(spark, K.slug, ["Bob  O'Neal", "!!"]) == ["bob-o-neal", "unknown"]
    assert one(spark, K.label_parts, ["A. One - B. Two -  - C. 3"]) == [["A. One", "B. Two", "C. 3"]]
    df = spark.createDataFrame([([" A ", "B", "A", ""],)], "t array<string>")
    assert df.select(K.distinct_labels(F.col("t"))).first()[0] == ["A", "B"]


def test_clock_and_stats(spark):
    assert one(spark, K.clock_minutes, ["32:30", "12.5", "x", None]) == [32.5, 12.5, 0.0, 0.0]
    assert one(spark, lambda c: K.stat_number(c, F.lit("3")), ["-", "0", "7", None]) == [3.0, 3.0, 7.0, 3.0]


def test_clip_keeps_null(spark):
    assert one(spark, lambda c: K.clip(c, 0, 1), [None, 2.0, -1.0], "double") == [None, 1.0, 0.0]


def z_row(spark, **z):
    from tallyframe.preset import METRICS
    return spark.createDataFrame([tuple(float(z.get(m, 0.0)) for m in METRICS)], ", ".join(f"{m}_z double" for m in METRICS))


def test_ladders(spark):
    row = z_row(spark, pts_per36=1.2, ast_per36=1.1, ast_pct=0.9, stl_per36=0.9, fg3a_rate=0.9, efg_pct=0.3)
    a = row.select(rules.archetypes(rules.zcols()).alias("a"), rules.player_role(rules.zcols()).alias("r"), rules.unit_roles(rules.zcols()).alias("u")).first()
    assert a.a == ["high-volume creator", "perimeter scorer", "table setter"]
    assert a.r == "Playmaker" and a.u == ["Playmaker", "Perimeter Specialist"]
    flat = z_row(spark).select(rules.archetypes(rules.zcols()).alias("a"), rules.player_role(rules.zcols()).alias("r"), rules.unit_roles(rules.zcols()).alias("u")).first()
    assert flat.a == ["balanced scorer", "box-score defender"] and flat.r == "Defensive Specialist" and flat.u == ["Defensive Specialist"]


def test_scores(spark):
    mid = {m: F.lit(50.0) for m in ("pts_per36",)}
    df = spark.range(1)
    got = df.select(scores.impact_score(mid).alias("m"), scores.impact_score({}, F.lit(0.2)).alias("n"), scores.polygon_score({k: F.lit(100.0) for k in scores.P.SKILL_AXES}).alias("p"),
                    scores.credibility(F.lit(625.0)).alias("c"), scores.verdict(F.lit(-0.8)).alias("v"), scores.outlook(F.lit(0.5), F.lit(0.01))["projected_wins"].alias("w")).first()
    assert got.m == pytest.approx(got.n) and got.p == pytest.approx(1.0) and got.c == pytest.approx(0.5) and got.v == "modest step back" and got.w == 41.0


def test_career_team_runs_and_zero_minutes(spark):
    from tallyframe.preset import METRICS
    cols = ", ".join(f"{m} double, {m}_z double" for m in METRICS)
    fill = [0.5, 1.0] * len(METRICS)
    rows = [(1, "P", s, int(s[:4]), t, g, m, "PG", "G", "6-3", "200", "2000", "1", *fill) for s, t, g, m in
            (("2000-01", "A", 0.0, 0.0), ("2001-02", "B", 0.0, 0.0), ("2002-03", "B", 0.0, 0.0), ("2003-04", "A", 0.0, 0.0))]
    df = spark.createDataFrame(rows, "player_id int, player_name string, season string, season_start int, team string, gp double, min double, position string, "
                                     f"position_group string, height string, weight string, draft_year string, draft_number string, {cols}")
    r = C.roll_up(df).first()
    assert r.career_teams == ["A", "B", "A"] and r.pts_per36 == 0.5 and r.career_span == "2000-01 to 2003-04" and r.weight == "200"


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, keyed_upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    base = spark.createDataFrame([(1,), (2,), (4,)], "k int")
    assert sorted((r.k, r.v) for r in partial_upsert(base, old, new, ["k"], "v").collect()) == [(1, "a"), (2, "B")]
    real = spark.createDataFrame([(1,)], "k int")
    proj = spark.createDataFrame([(2, True)], "k int, is_prospect boolean")
    assert sorted((r.k, r.is_prospect) for r in combine_rows(real, proj).collect()) == [(1, False), (2, True)]
