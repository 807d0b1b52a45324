from pyspark.sql import functions as F

from tallyframe.operators import lineups as L
from tallyframe.operators import search as S
from tallyframe.sources import landed

PAGE = """<h2>Draft 2026 NBA Draft</h2><table><tr><th>X</th></tr><tr><td>1</td></tr></table>
<h2>College <b>Stats</b></h2><table><thead><tr><th>Player</th><th>GP</th></tr></thead><tbody>
<tr><td><a href="/player/a/Summary/1">Ann &amp; Co</a></td><td>12</td></tr><tr><td>Bo</td><td>-</td></tr></tbody></table>"""


def test_html_tables(spark):
    rows = landed.table_rows(spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>none</p>")], "page_id int, html string"))
    out = landed.rows_with_headers(rows, ["Player", "GP"], ["Player", "GP"]).orderBy("row_no").collect()
    assert [(r.page, r.title, r.Player, r.GP, r.link) for r in out] == [(1, "College Stats", "Ann & Co", "12", "/player/a/Summary/1"), (1, "College Stats", "Bo", "-", "")]


def test_page_fields(spark):
    text = "<p><strong>College:</strong> <a href='x'>Duke (2019)</a></p><strong>Height:</strong> 6-7 <strong>Weight:</strong> 210lbs NBA Draft 2024"
    r = spark.createDataFrame([(text,)], "t string").select(landed.profile_team(F.col("t")).alias("team"), landed.class_year(F.col("t")).alias("y"),
                                                           *[c.alias(k) for k, c in landed.profile_size(F.col("t")).items()]).first()
    assert (r.team, r.y, r.height, r.weight) == ("Duke", 2024, "6-7", "210")


def test_rowset_and_prospect_files(spark, tmp_path):
    payload = '{"resultSets":[{"headers":["GP","NAME"],"rowSet":[["10","a"],["x","b"]]}]}'
    out = landed.rowset_rows(spark.createDataFrame([(1, payload)], "id int, t string"), "t", {"GP": "int", "NAME": "string"}, ["id"]).collect()
    assert sorted((r.name, r.gp) for r in out) == [("a", 10), ("b", None)]
    (tmp_path / "prospects_2020.json").write_text('[{"id": 1}]')
    (tmp_path / "prospects.json").write_text('{"draft_class_year": 2026, "prospects": [{"id": 2}, {"id": 3}]}')
    got = landed.prospect_files(spark, str(tmp_path), "struct<id:int>").collect()
    assert sorted((r.class_year, r.id) for r in got) == [(2020, 1), (2026, 2), (2026, 3)]


def test_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    landed.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "v int, season string"), path, ["season"])
    landed.replace_partitions(spark.createDataFrame([(9, "b")], "v int, season string"), path, ["season"])
    stored = landed.read_if_matching(spark, path, ["v", "season"])
    assert sorted(map(tuple, stored.collect())) == [(1, "a"), (9, "b")]
    assert landed.read_if_matching(spark, path, ["v"]) is None and landed.read_if_matching(spark, path + "x", ["v"]) is None
    assert sorted(r.season for r in landed.completed_seasons(stored, spark).collect()) == ["a", "b"]


def test_label_matching(spark):
    roster = spark.createDataFrame([("T", "s", 1, "Ann Lee"), ("T", "s", 2, "Al Lee"), ("T", "s", 3, "Bo Van Dyke"), ("T", "s", 4, "Cy Young-Poe"), ("T", "s", 5, "Di")],
                                   "team string, season string, player_id int, player_name string")
    labels = spark.createDataFrame([("T", "s", i, x) for i, x in enumerate(["ANN LEE", "A. Lee", "B. Dyke", "Poe", "X. Lee", "di"])], "team string, season string, pos int, label string")
    got = {r.label: r.player_id for r in L.match_labels(labels, roster).collect()}
    assert got == {"ANN LEE": 1, "A. Lee": 1, "B. Dyke": 3, "Poe": 4, "X. Lee": None, "di": 5}


def test_label_matching_handles_no_row_per_name_ending(spark):
    """Endings of all names were rows, sent to every task where the roster's files were small."""
    roster = spark.createDataFrame([("T", "s", i, f"Ann Lee{i}") for i in range(9)] + [("T", "s", 20, "Ann Lee20"), ("T", None, 7, "Ann Lee7")],
                                   "team string, season string, player_id int, player_name string")
    labels = spark.createDataFrame([("T", "s", 0, "A. Lee3"), ("T", "s", 1, "0"), ("T", "s", 2, "e7"), ("T", "s", 3, " "), ("T", "s", 4, None)],
                                   "team string, season string, pos int, label string")
    out = L.match_labels(labels, roster)
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.pos: r.player_id for r in out.collect()} == {0: 3, 1: None, 2: 7, 3: None, 4: None}


def test_search(spark):
    assert round(S.indel_ratio("lebron", "lebrn"), 4) == 90.9091 and S.token_set_ratio("james lebron", "lebron james jr") == 100.0
    names = spark.createDataFrame([(1, "LeBron James"), (2, "James Harden"), (3, "Bronny James"), (4, "Zed")], "player_id int, player_name string")
    got = S.search_players(names, "james", 5).collect()
    assert [(r.player_id, r.score) for r in got] == [(3, 115.0), (2, 115.0), (1, 115.0)]
    assert S.search_players(names, "lebrn jmes", 1).first().player_id == 1
    teams = spark.createDataFrame([(1, "Los Angeles Lakers", "LAL", "Lakers"), (2, "Boston Celtics", "BOS", "Celtics")], "team_id int, name string, abbreviation string, nickname string")
    assert [r.team_id for r in S.search_teams(teams, "lkr").collect()] == [1]
    r = S.search_teams(teams, "bos").first()
    assert (r.team_id, r.score) == (2, 100.0)


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([("a", "<table><tr><th>X</th></tr><tr><td>1</td></tr></table>" * 2), (None, "<table><tr><th>X</th></tr><tr><td>2</td></tr></table>")],
                                  "page_id string, html string")
    rows = landed.rows_with_headers(landed.table_rows(pages), ["X"], ["X"])
    assert [(r.page, r.X) for r in rows.collect()] == [("a", "1")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_partitions_grow_with_rows(spark):
    """A task's share of a big table stays bounded; small tables change nothing, and a number once raised stays."""
    from tallyframe import session as T

    before = spark.conf.get(T.INITIAL, None)
    try:
        T.spread_rows(spark, 10)
        assert spark.conf.get(T.INITIAL, None) == before
        T.spread_rows(spark, 40 * T.TASK_ROWS + 1)
        T.spread_rows(spark, 10)
        assert spark.conf.get(T.INITIAL) == "41"
    finally:
        spark.conf.set(T.INITIAL, before) if before else spark.conf.unset(T.INITIAL)


def test_conditions_packed_in_one_number_come_out_as_they_were(spark):
    from itertools import product

    from tallyframe.sources.boxscore import _digits, _held

    rows = [*product(["R", "A", "N", "X", None], [0.04, 0.05, None], [1, 2, 3, 7, None])]
    df = spark.createDataFrame(rows, "f string, d double, n int")
    f, d, n = F.col("f"), F.col("d"), F.col("n")
    parts = ([f == "R", f == "A", f == "N"], f), ([d >= 0.05], d), ([n == 1, n.isin(2, 3)], n)
    held = _held(F.col("packed"), [3, 1, 2])
    again = df.withColumn("packed", _digits(*parts)).select(*[x.alias(f"b{i}{j}") for i, own in enumerate(held) for j, x in enumerate(own)],
                                                           *[x.alias(f"a{i}{j}") for i, (own, _) in enumerate(parts) for j, x in enumerate(own)])
    for r in again.collect():
        r = r.asDict()
        assert all(r[f"a{k[1:]}"] == v for k, v in r.items() if k[0] == "b"), r
