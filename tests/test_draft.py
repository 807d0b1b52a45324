"""Draft classes from stored JSON of mixed shapes."""

import pytest
from pyspark.sql import functions as F

from tallyframe.plans import draft as D

PAYLOADS = [
    (True, None, '{"draft_class_year": 2030, "prospects": [{"prospect_id": "a", "mpg": {"value": 30, "percentile": 1}, "pts_per36": {"value": "20.5"}, "ts_pct": {"value": 0.6}, "gp": 25, "height": "6-5"},'
                 ' {"prospect_id": "b", "mpg": {"value": null}, "pts_per36": 10, "ts_pct": "0.5", "raw_stats": {"mpg": 12, "ppg": 3.5}, "height": 78}]}'),
    (False, 2029, '[{"prospect_id": "a", "mpg": 5, "pts_per36": {"value": "many"}}, {"prospect_id": "c", "team": "X", "pick": 3, "raw_stats": {"ppg": 9}}]'),
    (False, 2028, "{no json"), (False, 2027, None)]
SCHEMA = "current boolean, class_year int, payload string"


def test_values_of_any_shape(spark):
    rows = {(r["current"], r["prospect_id"]): r for r in D.prospect_rows(D.payload_records(spark.createDataFrame(PAYLOADS, SCHEMA))).collect()}
    got = {k: (r["class_year"], r["mpg"], r["own_mpg"], r["pts_per36"], r["own_pts_per36"], r["ts_pct"], r["own_ts_pct"]) for k, r in rows.items()}
    assert got == {(True, "a"): (2030, 30.0, 30.0, 20.5, 20.5, 0.6, 0.6), (True, "b"): (2030, 12.0, None, 10.0, None, 0.5, None),
                   (False, "a"): (2029, 5.0, None, None, None, None, None), (False, "c"): (2029, None, None, None, None, None, None)}
    assert rows[True, "b"]["height"] == "78" and rows[False, "c"]["pick"] == 3 and rows[True, "a"]["gp"] == 25


def test_lists_detail_and_meta(spark):
    payloads = spark.createDataFrame(PAYLOADS, SCHEMA)
    scored = D.scored_classes(D.prospect_rows(D.payload_records(payloads))).cache()
    by = {(r["current"], r["prospect_id"]): r for r in scored.collect()}
    assert by[True, "a"]["mpg_pct"] == 100.0 and by[True, "b"]["mpg_pct"] == pytest.approx(200 / 3) and by[False, "c"]["mpg_pct"] == 0.0
    assert by[True, "b"]["adjusted"] == 0.0  # minutes not stored as an object
    assert [r["prospect_id"] for r in D.draft_list(scored).orderBy("prospect_id").collect()] == ["a", "b"]
    past = {r["prospect_id"]: r for r in D.draft_list(scored, 2029).collect()}
    assert past["c"]["box_score"]["ppg"].asDict() == {"value": 9.0, "percentile": 100.0} and past["a"]["box_score"]["ppg"].asDict() == {"value": 0.0, "percentile": 0.0}
    detail = D.draft_detail(scored, "a").collect()
    assert len(detail) == 1 and detail[0]["current"] and set(detail[0]["metrics"]) == {"mpg", "pts_per36", "ts_pct"}
    assert 0 < detail[0]["raw_stats"]["apfv"] <= 0.99 and D.draft_detail(scored, "z").collect() == []
    assert tuple(D.draft_meta(payloads, 2050).first()) == (2030, [2027, 2028, 2029])
    assert tuple(D.draft_meta(payloads.where("not current"), 2050).first()) == (2030, [2027, 2028, 2029])
    assert tuple(D.draft_meta(payloads.where(F.lit(False)), 2050).first()) == (2050, [])
