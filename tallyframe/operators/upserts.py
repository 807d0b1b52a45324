"""Bringing fresh rows into stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import season_start


def keyed_upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows win; stored rows of other keys stay."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def replace_slices(stored: DataFrame, fresh: DataFrame | None, slice_by: list[str]) -> DataFrame:
    """Stored rows of every slice (the season, say) the fresh load holds are replaced; no load keeps everything."""
    return stored if fresh is None else keyed_upsert(stored, fresh, slice_by)


def partial_upsert(base: DataFrame, stored: DataFrame, fresh: DataFrame, keys: list[str], column: str) -> DataFrame:
    """All keys of `base` with one carried column: fresh value, else stored value; keys with neither are dropped."""
    out = (base.join(stored.select(*keys, F.col(column).alias("_old")), keys, "left")
           .join(fresh.select(*keys, F.col(column).alias("_new")), keys, "left"))
    return out.withColumn(column, F.coalesce("_new", "_old")).drop("_new", "_old").where(F.col(column).isNotNull())


def missing_slices(wanted: DataFrame, stored: DataFrame, slice_by: list[str], force: bool = False) -> DataFrame:
    """Slices still to build; all of them when forced."""
    return wanted if force else wanted.join(stored.select(*slice_by).distinct(), slice_by, "left_anti")


def known_keys(teams: DataFrame) -> DataFrame:
    """Distinct team seasons with their sort key and a mark for the latest season."""
    rows = teams.select("team_id", "season").distinct().withColumn("season_start", season_start(F.col("season")))
    newest = rows.agg(F.max("season_start").alias("_newest"))
    from .attach import attach_row

    out = attach_row(rows, newest).withColumns({
        "key": F.concat_ws(":", F.col("team_id").cast("string"), F.col("season")), "latest": F.col("season_start") == F.col("_newest")})
    return out.drop("_newest").orderBy("season_start", "team_id")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def combine_rows(real: DataFrame, projected: DataFrame) -> DataFrame:
    """Real and projected rows in one table; the projection mark is false where it is missing."""
    out = real.unionByName(projected, allowMissingColumns=True)
    return out.withColumn("is_prospect", F.coalesce("is_prospect", F.lit(False)))
