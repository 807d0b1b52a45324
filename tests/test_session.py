"""Stage tables and the files they leave."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import crosspool as X
from tallyframe.operators.neighbours import Search, distances, nearest
from tallyframe.session import cut_built, cut_files, cut_lineage, lasting, read_file, read_group, release, row_groups


def shuffle_files(spark) -> int:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum("shuffle" in str(blocks.apply(i)) for i in range(blocks.size()))


def there(table) -> bool:
    return os.path.isdir(table.stage_path)


def test_shuffle_files_go_with_the_job_that_wrote_them(spark):
    before = shuffle_files(spark)
    table = cut_lineage(spark.range(100_000).withColumn("k", F.xxhash64("id")).repartition(7, "k"))
    assert shuffle_files(spark) <= before
    assert table.count() == 100_000


def test_tables_written_on_the_way_go_when_the_last_one_is_written(spark):
    passing, kept = [], []

    def build():
        passing.append(cut_lineage(spark.range(10)))
        kept.append(lasting(lambda: cut_lineage(spark.range(3))))
        passing.append(cut_built(spark, lambda: passing[0].where("id > 2")))
        return passing[-1].crossJoin(kept[0].agg(F.max("id").alias("most")))

    table = cut_built(spark, build)
    assert there(table) and there(kept[0]) and not any(map(there, passing))
    assert sorted(r["id"] for r in table.collect()) == list(range(3, 10))
    release(kept[0])
    assert not there(kept[0])


def test_files_hold_ranges_of_about_equal_size_and_groups_come_in_blocks(spark):
    table, files = cut_files(spark.range(1000).selectExpr("id % 10 AS k", "id"), 4, "k", "id")
    parts = [read_file(f).to_pandas() for f in files]
    assert sum(map(len, parts)) == table.count() == 1000 and max(map(len, parts)) < 500
    rows = [tuple(r) for p in parts for r in p.to_numpy()]
    assert rows == sorted(rows)
    sizes = [len(b) for g in row_groups(table) for b in read_group(*g, 64)]
    assert sum(sizes) == 1000 and max(sizes) <= 64


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_copy_no_row_for_the_cells_it_meets(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 3))
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(v)], "id long, vec array<double>")
    found = nearest(rows, rows, Search(5, leaf_rows=4, block_rows=20), lambda q, p: np.where(q["id"][:, None] == p["id"][None, :], -np.inf, -distances(q["vec"], p["vec"])), lambda d: -d)
    assert "Exchange" not in plan(found) and "CoGroup" not in plan(found)
    d = distances(v, v) + np.diag([np.inf] * 300)
    got = found.toPandas().sort_values(["id", "rank"])
    assert got.other.tolist() == np.argsort(d, 1)[:, :5].ravel().tolist() and got["rank"].tolist() == [1, 2, 3, 4, 5] * 300


def test_neighbours_of_rows_that_share_an_id_are_ranked_together(spark):
    v = [(1, 0.0), (1, 10.0), (2, 0.1), (3, 9.8), (4, 0.3), (4, 0.3), (5, None)]
    rows = spark.createDataFrame([(i, "s" if x is not None else None, [x or 0.0]) for i, x in v], "id long, stratum string, vec array<double>")
    score = lambda q, p: np.where(q["id"][:, None] == p["id"][None, :], -np.inf, -distances(q["vec"], p["vec"]))
    got = nearest(rows, rows, Search(3), score, lambda d: -d).toPandas().sort_values(["id", "rank"])
    assert got[got.id == 1].other.tolist() == [2, 3, 4] and got[got.id == 2].other.tolist() == [1, 4, 4]
    assert 5 not in set(got.id)


@pytest.mark.parametrize("rows", [None, 4])
def test_comps_copy_no_row_for_the_blocks_it_meets(spark, rows):
    rng = np.random.default_rng(5)
    vec = lambda: [float(x) for x in rng.normal(size=4)]
    q = spark.createDataFrame([(i, i % 3, f"n{i}", vec(), 1.5, 0.7, 0.5) for i in range(30)],
                              "id int, class int, name string, full array<double>, sd_h double, sd_w double, scoring double")
    pool = spark.createDataFrame([(j, f"p{j}", vec(), 0.5, 0.5, [vec()] * (j % 3)) for j in range(60)],
                                 "id int, name string, full array<double>, prior double, scoring double, near array<array<double>>")
    left, right = X._blocks(q, pool, rows)
    assert (left.count(), right.count()) == (30, 60)
    p = X.CompParams(weights=(1.0, 1.0, 0.3, 0.3), bandwidth=0.8)
    found = X.ranked_comps(q, pool, p, top=7, rows=rows)
    assert "Exchange" not in plan(found)
    whole = X.ranked_comps(q, pool, p, top=60, rows=rows).toPandas()
    assert len(whole) == 30 * 60
    best = whole[whole["rank"] <= 7].sort_values(["prospect_id", "rank"]).player_id.tolist()
    assert found.toPandas().sort_values(["prospect_id", "rank"]).player_id.tolist() == best
    twice = X.ranked_comps(q.union(q.where("id < 2")), pool, p, top=4, rows=rows).toPandas().sort_values(["prospect_id", "rank"])
    assert twice.groupby("prospect_id").player_id.nunique().tolist() == [2, 2] + [4] * 28
