import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import ranking as R


def table(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": range(n), "g": rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05]), "x": rng.normal(size=n).round(1),
                        "y": np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n))})
    pdf.loc[rng.choice(n, 40, replace=False), "x"] = None
    return pdf, spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))


@pytest.mark.parametrize("limit", [10**6, 30])
def test_percentiles_equal_pandas_with_ties_nulls_and_a_hot_value(spark, limit):
    pdf, df = table(spark)
    out = R.with_percentiles(df, ["x", "y"], ["g"], ["id"], limit=limit).toPandas().set_index("id").sort_index()
    assert len(out) == len(pdf)
    for m in ("x", "y"):
        want = (pdf.groupby("g")[m].rank(pct=True) * 100).fillna(50.0)
        assert np.allclose(out[f"{m}_pctile"], want)


@pytest.mark.parametrize("limit", [10**6, 30])
def test_share_and_ordinal_over_everything(spark, limit):
    pdf, df = table(spark)
    got = R.with_ranks(df, {"s": ("y", R.pct_le)}, [], ["id"], limit).toPandas().set_index("id").sort_index()
    assert np.allclose(got["s"], pdf["y"].rank(pct=True, method="max") * 100)
    pos = R.with_ordinal(df, "y", ["g"], ["id"], limit=limit).toPandas().sort_values(["g", "y", "id"])
    assert (pos.groupby("g").cumcount() + 1 == pos["ord"]).all()
    assert (pos["ord_n"] == pos.groupby("g")["id"].transform("size")).all()


@pytest.mark.parametrize("limit", [10**6, 20])
def test_rank_in_reference(spark, limit):
    rng = np.random.default_rng(5)
    ref, asked = rng.normal(size=200).round(1), rng.normal(size=50).round(1)
    out = R.rank_in_reference(
        spark.createDataFrame([(i, "k", float(v)) for i, v in enumerate(asked)], "_vid bigint, k string, value double"),
        spark.createDataFrame([("k", float(v)) for v in ref], "k string, value double"), ["k"], limit=limit).toPandas().set_index("_vid").sort_index()
    want = [100 * ((ref < v).sum() + (ref <= v).sum()) / (2 * len(ref)) for v in asked]
    assert np.allclose(out["pct"], want)


def test_zscores_without_spread(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (3, "b", 1.0), (4, "b", 3.0), (5, "b", None)], "id int, g string, v double")
    zero = {r.id: r.v_z for r in R.with_zscores(df, ["v"], ["g"]).collect()}
    assert zero == {1: 0.0, 2: 0.0, 3: -1.0, 4: 1.0, 5: 0.0}
    sample = {r.id: r.v_z for r in R.with_zscores(df, ["v"], ["g"], sample=True, flat="unit").collect()}
    assert sample[1] == 0.0 and sample[4] == pytest.approx(1 / 2**0.5)


@pytest.mark.parametrize("limit", [10**6, 30])
def test_null_groups_mostly_null_values_one_value_and_tiny_values(spark, limit):
    rng = np.random.default_rng(9)
    n = 400
    pdf = pd.DataFrame({"id": range(n), "g": rng.choice(["a", None], n), "rare": np.where(rng.random(n) < 0.9, np.nan, rng.normal(size=n)),
                        "same": 2.5, "tiny": rng.permutation(n) * 1e-10})
    df = spark.createDataFrame([(int(r.id), r.g, *(None if np.isnan(x) else float(x) for x in (r.rare, r.same, r.tiny))) for r in pdf.itertuples()],
                               "id bigint, g string, rare double, same double, tiny double")
    out = R.with_percentiles(df, ["rare", "same", "tiny"], ["g"], ["id"], limit=limit).toPandas().set_index("id").sort_index()
    assert len(out) == n
    for m in ("rare", "same", "tiny"):
        want = (pdf.groupby("g", dropna=False)[m].rank(pct=True) * 100).fillna(50.0)
        assert np.allclose(out[f"{m}_pctile"], want)
    place = R.with_ordinal(df, "tiny", ["g"], ["id"], limit=limit).toPandas().set_index("id").sort_index()
    assert len(place) == n and (place["ord"] == pdf.groupby("g", dropna=False)["tiny"].rank().astype(int)).all()
    asked = df.selectExpr("id AS _vid", "g", "tiny AS value")
    seen = R.rank_in_reference(asked, df.selectExpr("g", "tiny AS value"), ["g"], formula=R.pct_le, limit=limit).toPandas().set_index("_vid").sort_index()
    assert len(seen) == n and np.allclose(seen["pct"], pdf.groupby("g", dropna=False)["tiny"].rank(pct=True) * 100)


def test_zscores_of_a_null_group(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 3.0), (3, "b", 5.0)], "id int, g string, v double")
    assert {r.id: r.v_z for r in R.with_zscores(df, ["v"], ["g"]).collect()} == {1: -1.0, 2: 1.0, 3: 0.0}


@pytest.mark.parametrize("places", [10**6, 5])
def test_ways_of_ranking_agree_on_repeated_and_null_keys(spark, monkeypatch, places):
    rng = np.random.default_rng(4)
    rows = [(int(i) if i % 17 else None, g, float(v) if v else None, float(i % 5)) for i, g, v in zip(rng.integers(0, 150, 300), rng.choice(["a", "b", None], 300).tolist(), rng.integers(0, 9, 300))]
    df = spark.createDataFrame(rows, "id bigint, g string, x double, y double")
    outputs = {"p": ("x", R.pct_avg), "q": ("y", R.pct_le), "r": ("x", R.pct_le)}
    monkeypatch.setattr(R, "PLACES", places)
    by_sort, by_value = (R.with_ranks(df, outputs, ["g"], ["id"], limit, 50.0) for limit in (10**6, 20))
    assert by_sort.columns == by_value.columns
    found = [sorted((tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in x.select("g", "id", "p", "q", "r").collect()), key=lambda t: str(t)) for x in (by_sort, by_value)]
    assert found[0] == found[1] and len(found[0]) == df.select("g", "id").distinct().count()


def test_rows_are_not_shuffled_for_ranks_of_few_values(spark):
    df = spark.range(2000).selectExpr("id", "id % 2 AS g", "double(id % 7) AS x", "repeat('w', 50) AS wide")
    out = R.with_percentiles(df, ["x"], ["g"], ["id"], limit=100)
    assert out.count() == 2000 and "Exchange hash" not in out._jdf.queryExecution().executedPlan().toString()


def test_one_metric_of_many_values_does_not_send_the_others_the_long_way(spark, monkeypatch):
    monkeypatch.setattr(R, "PLACES", 100)
    rows = [(i if i % 50 else None, "ab"[i % 2] if i % 7 else None, float(i % 3), float(i * 37 % 1009) if i % 11 else None, None) for i in range(900)]
    rows += [(5, "b", 7.0, 0.5, None), (5, "b", 0.0, None, None)]
    df = spark.createDataFrame(rows, "id bigint, g string, few double, many double, none double")
    outputs = {"p": ("few", R.pct_avg), "q": ("many", R.pct_le), "r": ("few", R.pct_le), "s": ("many", R.pct_avg), "t": ("none", R.pct_le)}
    by_sort, by_value = (R.with_ranks(df, outputs, ["g"], ["id"], limit, 50.0) for limit in (10**6, 20))
    plan = by_value._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2  # few and none; many is matched by key
    found = [sorted((str([None if v is None else round(v, 6) if isinstance(v, float) else v for v in r]) for r in x.select("g", "id", *outputs).collect())) for x in (by_sort, by_value)]
    assert found[0] == found[1] and len(found[0]) == df.select("g", "id").distinct().count()
