"""Conversation repair against all paths in Python."""

import random

import pytest

from checks import compare as X
from tallyframe.llm import registered as Q
from tallyframe.llm import repair as R
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string"
TEXTS = ["A b.", "So?", "no end", "", " \n", "Yes!  ", None, "same.", "same.", "x.\n"]
ROLES = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]


def some_rows(n, conversations, seed, longest=12):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(conversations)]), r.choice([None, *range(longest)]), r.choice(ROLES), r.choice(TEXTS)) for _ in range(n)]
    return rows + rows[: n // 10]


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_repair_equals_all_paths(spark):
    rows = some_rows(900, 120, 1)
    assert got(R.repaired(spark.createDataFrame(rows, SCHEMA))) == brute.repair(rows)


@pytest.mark.parametrize("bits", [1, 3])
def test_conversations_are_cut_into_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(R, "BLOCK_BITS", bits)
    rows = some_rows(400, 3, 2, 150) + [(77, k, ("user", "assistant")[k % 2], f"m {k}.") for k in range(70)]
    assert got(R.repaired(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute.repair(rows)


def test_damage_and_query_equal_plain_versions(spark, tmp_path):
    rows = some_rows(600, 90, 3) + [(1000 + k, 0, "user", "gone?") for k in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {c: (0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855") for c, *_ in rows} | brute.repair(brute.damage(rows))
    assert got(Q.op11_conversation_repair(spark, str(tmp_path))) == want


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = Q.op11_conversation_repair(spark, sf)
    assert X.compare(df.columns, [tuple(r) for r in df.collect()], *X.run_sql(X.duck(sf), Q.O["op11_conversation_repair"])) == ""


def test_repaired_messages_alternate(spark):
    rows = some_rows(500, 40, 4)
    ordered = R.in_order(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS uid", "3 AS audit"))
    _, pieces = R.planned(ordered)
    convs = {}
    for r in R.repaired_messages(ordered, pieces).orderBy("key", "place").collect():
        convs.setdefault(r["key"], []).append(r)
    assert len(convs) == len({c for c, *_ in rows})
    for own in convs.values():
        roles = [r["role"][0] for r in own if r["edit"] != "D"]
        roles = roles[1:] if roles[:1] == ["s"] else roles
        assert roles == ["u", "a"] * (len(roles) // 2) and all((r["uid"] is None) == (r["edit"] == "I") for r in own)


def test_empty_and_very_long(spark):
    assert R.repaired(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, 0, "user", "long " * 400_000 + "."), (1, 1, "user", "long " * 400_000), (1, 2, "assistant", None)]
    assert got(R.repaired(spark.createDataFrame(rows, SCHEMA))) == brute.repair(rows)


def test_ids_of_other_types(spark):
    rows = [("b", 0, "user", "Hi."), ("b", 1, "user", "Hi?"), (None, 0, "user", "Hi.")]
    got_rows = {r["conv_id"]: r["audit"] for r in R.repaired(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert got_rows == {"b": "KR", None: "KI"}
