"""Exact ranks and z-scores that hold when one group has a third of all rows.

Every percentile definition is arithmetic on three counts per row and metric: values below
(`lt`), values at or below (`le`) and values in the group (`n`). They are found in long form
(one row per row and metric), so that many metrics share one shuffle and one sort.

Groups beyond `limit` rows are ranked by their distinct values: equal values are counted before the sort, the counts are
sorted in ranges across all groups, running sums within a range are shifted by the sums of the ranges before it, and
the counts are joined back to the rows. Metrics with the fewest distinct values, counted first, up to `PLACES` in all, are sent to the rows, which need no shuffle; of the
others alone keys and values are shuffled, and the rows once, for the ranks found. Null groups are groups, and null values take no part in any sort. The limits decide
the way only, never the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .attach import attach_groups, keys_repeat, match, rows_per_group

LIMIT = 100_000  # rows of a group that one task sorts
PLACES = 1_000_000  # distinct values, over all groups and the metrics with the fewest, that are sent to every task
SALTS = 64
Counts = Callable[[Column, Column, Column], Column]


# ---- the percentile definitions ------------------------------------------------
def pct_avg(lt: Column, le: Column, n: Column) -> Column:
    """Average-rank percentile, 0..100."""
    return (lt + le + 1) / 2.0 / n * 100.0


def pct_le(lt: Column, le: Column, n: Column) -> Column:
    """Share at or below, 0..100."""
    return le / n * 100.0


def pct_mid(lt: Column, le: Column, n: Column) -> Column:
    """Mid-rank against a reference the value may be part of, 0..100."""
    return (lt + le) / (2.0 * n) * 100.0


def clean_value(c: Column) -> Column:
    v = c.cast("double")
    return F.when(F.isnan(v), None).otherwise(v + F.lit(0.0))


# fixed: ranks are taken on values rounded to 37 binary digits (about 11 decimal ones), whatever their size. Sums of doubles depend on the order
# they are added in; values that differ only by that still tie
ROUND_SQL = "({v} * 65537D - ({v} * 65537D - {v}))"
# as text: long lists of columns are cheaper to build as expressions
RANK_SQL = ROUND_SQL.format(v="(nanvl(double(`{m}`), null) + 0D)")


def rank_value(c: Column) -> Column:
    v = clean_value(c)
    return v * 65537.0 - (v * 65537.0 - v)


def running(counts: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """`counts` (one row per group and value) with _le, the sum of weights up to the value, and _n, the group's sum. The sort is cut into ranges
    wherever it pleases, also within a group."""
    ordered = cut_lineage(counts.orderBy(*group, value).withColumn("_part", F.spark_partition_id()))
    local = ordered.withColumn("_local", F.sum(weight).over(Window.partitionBy("_part", *group).orderBy(value)))
    sums = ordered.groupBy("_part", *group).agg(F.sum(weight).alias("_s"))  # as many rows as ranges and groups
    whole = Window.partitionBy(*group)
    sums = sums.select("_part", *group, (F.sum("_s").over(whole.orderBy("_part")) - F.col("_s")).alias("_off"), F.sum("_s").over(whole).alias("_n"))
    return match(local, sums, ["_part", *group]).withColumn("_le", F.col("_off") + F.col("_local")).drop("_part", "_local", "_off")


def with_ranks(df: DataFrame, outputs: dict[str, tuple[str, Counts]], group: list[str], key: list[str],
               limit: int = LIMIT, default: float | None = None) -> DataFrame:
    """outputs: new column -> (value column, formula over lt, le, n). `key` identifies a row.
    Nulls and NaN take no part and get `default`."""
    names = list(dict.fromkeys(v for v, _ in outputs.values()))
    formulas = list(dict.fromkeys(f for _, f in outputs.values()))
    values = {m: RANK_SQL.format(m=m) for m in names}
    split = rows_per_group(df, group) > limit
    grouped = group or ["_all"]
    if not group:
        df = df.withColumn("_all", F.lit(0))
    entries = _entries(dict(enumerate(values.values())))
    ids = list(dict.fromkeys([*grouped, *key]))
    keep = [c for c in df.columns if c not in ids]
    made = [f"`{o}`" if default is None else f"coalesce(`{o}`, {default}D) AS `{o}`" for o in outputs]
    part = [*grouped, "m"]
    if split:
        wide = _ranked_by_values(df, outputs, values, formulas, grouped, ids, keep)
        return wide.selectExpr(*[c for c in ids if c != "_all"], *[f"`{c}`" for c in keep], *made)
    row = "named_struct(" + ", ".join(f"'{c}', `{c}`" for c in keep) + ")" if keep else "named_struct('_x', 1)"
    # the row itself travels with its first metric only
    long = df.selectExpr(*ids, f"{row} AS row", f"explode(array({entries})) AS e").selectExpr(
        *ids, "if(e.m = 0, row, null) AS row", "e.m", "e.v")
    # rows without value are spread: they are not ranked
    long = long.withColumn("s", F.when(F.col("v").isNull(), 1 + F.pmod(F.xxhash64(*key), F.lit(SALTS))).otherwise(0))
    w = Window.partitionBy(*part, "s").orderBy("v")
    ranked = long.withColumns({
        "lt": F.rank().over(w) - 1,
        "le": F.count("v").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "n": F.count("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })

    lt, le, n = (F.col(c).cast("double") for c in ("lt", "le", "n"))
    ranked = ranked.select(*ids, "row", "m", *[F.when(F.col("v").isNotNull(), f(lt, le, n)).alias(f"_r{k}") for k, f in enumerate(formulas)])
    wide = ranked.groupBy(*ids).agg(
        F.first("row", ignorenulls=True).alias("row"),
        *[F.expr(f"max(if(m = {names.index(v)}, _r{formulas.index(f)}, null)) AS `{out}`") for out, (v, f) in outputs.items()])
    return wide.selectExpr(*[c for c in ids if c != "_all"], *[f"row.`{c}` AS `{c}`" for c in keep], *made)


def _entries(values: dict[int, str]) -> str:
    return ", ".join(f"named_struct('m', {i}, 'v', {v})" for i, v in values.items())


def _ranked_by_values(df: DataFrame, outputs: dict[str, tuple[str, Counts]], values: dict[str, str], formulas: list[Counts],
                      grouped: list[str], ids: list[str], keep: list[str]) -> DataFrame:
    """Ranks of distinct values, found once and joined back. As in the other way, rows that share a key become one."""
    names, part = list(values), [*grouped, "m"]
    long = df.selectExpr(*ids, f"explode(array({_entries(dict(enumerate(values.values())))})) AS e").selectExpr(*ids, "e.m", "e.v").where("v is not null")
    counts = long.groupBy(*part, "v").agg(F.count(F.lit(1)).alias("cnt"))
    lt, le, n = (c.cast("double") for c in (F.col("_le") - F.col("cnt"), F.col("_le"), F.col("_n")))
    placed = cut_lineage(running(counts, part, "v", "cnt").select(*part, "v", *[f(lt, le, n).alias(f"_r{k}") for k, f in enumerate(formulas)]))
    again = keys_repeat(df, ids)
    sizes = {r["m"]: r["count"] for r in placed.groupBy("m").count().collect()}  # one row a metric
    many, room = [], PLACES
    for i in sorted(range(len(names)), key=lambda i: sizes.get(i, 0)):
        room -= sizes.get(i, 0)
        if room < 0:
            many.append(i)
    out = df
    if many:
        few = {i: list(values.values())[i] for i in many}
        asked = df.selectExpr(*ids, f"explode(array({_entries(few)})) AS e").selectExpr(*ids, "e.m", "e.v").where("v is not null")
        found = match(asked, placed.where(F.col("m").isin(many)), [*part, "v"]).groupBy(*ids).agg(*[
            F.expr(f"max(if(m = {i}, _r{k}, null)) AS `_r{k}_{i}`") for i in many for k in range(len(formulas))])
        out = match(df, found, ids, "left")
    for i, v in enumerate(values.values()):
        if i not in many:
            own = placed.where(F.col("m") == i).select(*grouped, F.col("v").alias("_v"), *[F.col(f"_r{k}").alias(f"_r{k}_{i}") for k in range(len(formulas))])
            out = match(out.withColumn("_v", F.expr(v)), F.broadcast(own), [*grouped, "_v"], "left")  # counted
    out = out.select(*ids, *keep, *[F.col(f"_r{formulas.index(f)}_{names.index(v)}").alias(o) for o, (v, f) in outputs.items()])
    if not again:
        return out
    return out.groupBy(*ids).agg(F.first(F.struct(F.lit(1).alias("_x"), *keep)).alias("_row"), *[F.max(o).alias(o) for o in outputs]).select(
        *ids, *[F.col("_row")[c].alias(c) for c in keep], *outputs)


def with_percentiles(df: DataFrame, metrics: list[str], group: list[str], key: list[str], suffix: str = "_pctile",
                     formula: Counts = pct_avg, limit: int = LIMIT, default: float | None = 50.0) -> DataFrame:
    return with_ranks(df, {f"{m}{suffix}": (m, formula) for m in metrics}, group, key, limit, default)


def with_ordinal(df: DataFrame, value: str, group: list[str], key: list[str], out: str = "ord",
                 size: str = "ord_n", limit: int = LIMIT) -> DataFrame:
    """1-based position by (value, key) within the group and the group size. No two rows tie, so
    big groups are cut at sampled (value, key) pairs."""
    split = rows_per_group(df, group) > limit
    grouped = group or ["_all"]
    if not group:
        df = df.withColumn("_all", F.lit(0))
    if not split:
        w = Window.partitionBy(*grouped).orderBy(rank_value(F.col(value)), *key)
        full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumns({out: F.row_number().over(w), size: F.count(F.lit(1)).over(full)}).drop("_all")
    ordered = cut_lineage(df.withColumn("_v", rank_value(F.col(value))).orderBy(*grouped, "_v", *key).withColumns(
        {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sums = ordered.groupBy("_part", *grouped).agg(F.count(F.lit(1)).alias("_s"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*grouped)
    sums = sums.select("_part", *grouped, "_first", (F.sum("_s").over(whole.orderBy("_part")) - F.col("_s")).alias("_off"), F.sum("_s").over(whole).alias(size))
    return (match(ordered, sums, ["_part", *grouped])
            .withColumn(out, F.col("_off") + F.col("_at") - F.col("_first") + 1).drop("_off", "_first", "_at", "_part", "_v", "_all"))


def with_zscores(df: DataFrame, metrics: list[str], group: list[str], suffix: str = "_z", sample: bool = False,
                 flat: str = "zero", floor: float = 1e-9, source: DataFrame | None = None) -> DataFrame:
    """(v - mean) / deviation per group; null gives 0. `flat` says what a group without spread
    does: 'zero' gives 0, 'unit' divides by 1, 'floor' divides by at least `floor`. `source`: the same rows where they are cheaper to read."""
    spread = "stddev_samp" if sample else "stddev_pop"
    value = "nanvl(double(`{m}`), null)"
    stats = (df if source is None else source).groupBy(*group).agg(*[
        F.expr(e) for m in metrics for e in (f"avg({value.format(m=m)}) AS `_avg_{m}`", f"{spread}({value.format(m=m)}) AS `_sd_{m}`")])
    if group:  # written, Spark sees how few groups there are and does not shuffle the rows to meet them
        stats = cut_lineage(stats)
    joined = attach_groups(df, stats, group)
    # fixed: deviations up to 1e-12 are rounding, not spread
    rule = {"zero": "if(`_sd_{m}` > 1e-12D, ({v} - `_avg_{m}`) / `_sd_{m}`, null)",
            "unit": "({v} - `_avg_{m}`) / if(`_sd_{m}` > 1e-12D, `_sd_{m}`, 1.0D)",
            "floor": "({v} - `_avg_{m}`) / greatest(coalesce(`_sd_{m}`, 0D), {f}D)"}[flat]
    out = [f"coalesce({rule.format(m=m, v=value.format(m=m), f=floor)}, 0D) AS `{m}{suffix}`" for m in metrics]
    return joined.selectExpr(*[f"`{c}`" for c in df.columns if c not in {f"{m}{suffix}" for m in metrics}], *out)


def rank_in_reference(values: DataFrame, reference: DataFrame, on: list[str], value: str = "value",
                      formula: Counts = pct_mid, default: float = 50.0, out: str = "pct",
                      limit: int = LIMIT) -> DataFrame:
    """Rank values against another table's values per group: both are ranked as one sorted line in
    which only reference rows count. `values` needs a unique `_vid` column; groups without reference
    rows give `default`."""
    line = values.select(*on, "_vid", rank_value(F.col(value)).alias("v"), F.lit(0).alias("ref")).unionByName(
        reference.select(*on, F.lit(None).cast("bigint").alias("_vid"), rank_value(F.col(value)).alias("v"),
                         F.lit(1).alias("ref"))).where("v is not null")
    counts = line.groupBy(*on, "v").agg(F.sum("ref").alias("c"), F.count(F.lit(1)).alias("rows"))
    if rows_per_group(counts, on) > limit:
        counts = running(counts, on, "v", "c")
    else:
        counts = counts.withColumn("_le", F.sum("c").over(Window.partitionBy(*on).orderBy("v")))
    counts = counts.select(*on, "v", F.col("_le").alias("le"), (F.col("_le") - F.col("c")).alias("lt"))
    sizes = reference.groupBy(*on).agg(F.count(clean_value(F.col(value))).alias("n"))
    ranked = match(match(values.withColumn("v", rank_value(F.col(value))), counts, [*on, "v"], "left"), sizes, on, "left")
    lt, le, n = (F.col(c).cast("double") for c in ("lt", "le", "n"))
    pct = F.when(F.col("n") > 0, formula(lt, le, n))
    return ranked.withColumn(out, F.coalesce(pct, F.lit(default))).drop("lt", "le", "n", "v")
