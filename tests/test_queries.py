"""Registered queries against their oracles on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks import compare as X

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = ["season_rates", "normalized_features", "career_rollup", "leaderboard", "similar_players", "team_style", "badge_leaders", "similar_teams",
         "stat_leaders", "starting_lineups", "unit_model_features", "prospect_scores", "html_tables", "subsequence_search", "season_bundle"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, name):
    df = queries()[name](spark, SF)
    assert X.compare(df.columns, [tuple(r) for r in df.collect()], *X.run_sql(X.duck(SF), oracle_sql()[name])) == ""


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
