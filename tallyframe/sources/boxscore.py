"""Box-score view of TPC-H-like tables: one row per entity and season, integer-valued totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import season_label
from ..session import cut_lineage, spread_rows

ENTITY_KEYS = {"supplier": "l_suppkey", "part": "l_partkey", "customer": "o_custkey"}
NAMES = {"supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name"), "customer": ("c_custkey", "c_name")}
SUMMED = ["gp", "min", "fga", "fgm", "fg3a", "fg3m", "fta", "ftm", "oreb", "dreb", "ast", "stl", "blk", "tov", "w", "l"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digits(*parts: tuple[list[Column], Column]) -> Column:
    """One number for many conditions, each a part's condition that holds (from 1 on), 0 for none, or one more than their number where its column is null."""
    out = F.lit(0)
    for cases, value in reversed(parts):
        digit = F.when(value.isNull(), len(cases) + 1)
        for i, case in enumerate(cases):
            digit = digit.when(case, i + 1)
        out = out * (len(cases) + 2) + digit.otherwise(0)
    return out


def _held(packed: Column, sizes: list[int]) -> list[list[Column]]:
    """The conditions of `_digits` again: a part's, null where its column was."""
    out, under = [], 1
    for n in sizes:
        digit = F.floor(packed / under) % (n + 2)
        out.append([F.when(digit <= n, digit == i + 1) for i in range(n)])
        under *= n + 2
    return out


def play_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with the 0/1 box-score marks and the orderer's nation."""
    line = table(spark, sf_dir, "lineitem")
    spread_rows(spark, line.count())
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    c = F.col

    def mark(cond):
        return cond.cast("int")

    placed = orders.join(customer, orders.o_custkey == customer.c_custkey)  # first: a quarter of the rows of the lines
    flag = c("l_returnflag")
    marks = _digits(([flag == "R", flag == "A", flag == "N"], flag), ([c("l_discount") >= 0.05], c("l_discount")), ([c("l_tax") >= 0.04], c("l_tax")),
                    ([c("l_linestatus") == "F"], c("l_linestatus")), ([c("l_linenumber") == 1, c("l_linenumber").isin(2, 3)], c("l_linenumber")))
    # what a line's marks follow from travels as one number: the lines are shuffled
    packed = line.select("l_orderkey", "l_partkey", "l_suppkey", F.year("l_shipdate").alias("season_start"), c("l_quantity").alias("min"), marks.alias("marks"))
    joined = packed.join(placed, packed.l_orderkey == placed.o_orderkey)
    (missed, won, lost), (three,), (free,), (final,), (first, early) = _held(c("marks"), [3, 1, 1, 1, 2])
    made = ~missed
    return joined.select(
        "l_orderkey", "l_partkey", "l_suppkey", "o_custkey", c("c_nationkey").alias("nation"), "season_start", "min",
        F.lit(1).alias("fga"), mark(made).alias("fgm"), mark(three).alias("fg3a"),
        mark(three & made).alias("fg3m"), mark(free).alias("fta"),
        mark(free & final).alias("ftm"), mark(first).alias("oreb"), mark(early).alias("dreb"),
        mark(c("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("ast"),
        mark(c("o_orderstatus") == "P").alias("stl"), mark(c("min") >= 45).alias("blk"),
        mark(missed).alias("tov"), mark(won).alias("w"), mark(lost).alias("l"),
    )


def _season_sums(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per key and season. An order has one customer, hence one nation: distinct orders per
    nation add up to distinct orders, and partial sums per nation keep a hot entity spread out."""
    sums = [F.sum(s).cast("double").alias(s) for s in SUMMED if s != "gp"]
    by_nation = lines.groupBy(*keys, "season_start", "nation").agg(
        F.countDistinct("l_orderkey").cast("double").alias("gp"), F.count(F.lit(1)).alias("lines"), *sums)
    return by_nation.groupBy(*keys, "season_start").agg(
        F.max_by("nation", F.struct("lines", -F.col("nation"))).alias("team_nation"),
        *[F.sum(s).alias(s) for s in SUMMED])


def _derived(df: DataFrame) -> DataFrame:
    c = F.col
    share = lambda a, b: F.coalesce(F.try_divide(c(a), c(b)), F.lit(0.0))
    return df.withColumns({
        "season": season_label(c("season_start")), "reb": c("oreb") + c("dreb"),
        "pts": 2.0 * c("fgm") + c("fg3m") + c("ftm"), "pf": F.lit(0.0),
        "fg_pct": share("fgm", "fga"), "fg3_pct": share("fg3m", "fg3a"), "ft_pct": share("ftm", "fta"),
    })


def names(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    """Entity ids and names; parts are named by their first two words and the key."""
    id_col, name_col = NAMES[entity]
    dim = table(spark, sf_dir, entity).select(F.col(id_col).alias("player_id"), F.col(name_col).alias("player_name"))
    if entity != "part":
        return dim
    words = F.split(F.initcap("player_name"), " ")
    return dim.withColumn("player_name", F.concat(
        F.get(words, F.lit(0)), F.lit(" "), F.get(words, F.lit(1)), F.col("player_id").cast("string")))


def entity_seasons(spark: SparkSession, sf_dir: str, entity: str = "supplier") -> DataFrame:
    """Season totals with the bio columns of the entity."""
    key = ENTITY_KEYS[entity]
    lines = play_lines(spark, sf_dir).withColumnRenamed(key, "player_id")
    sums = _derived(_season_sums(lines, ["player_id"]))
    dim = names(spark, sf_dir, entity)
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("team_nation"), F.col("n_name").alias("team"))
    out = sums.join(dim, "player_id").join(nation, "team_nation")
    return with_bio(out).drop("team_nation", "w", "l")


def with_bio(df: DataFrame) -> DataFrame:
    """Position, size and draft labels that follow from the key."""
    k = F.col("player_id")
    inches = 66 + k % 22
    return df.withColumns({
        "position_group": F.element_at(F.array(F.lit("G"), F.lit("W"), F.lit("B")), (k % 3 + 1).cast("int")),
        "position": F.element_at(F.array(F.lit("PG"), F.lit("SF"), F.lit("C")), (k % 3 + 1).cast("int")),
        "height": F.concat(F.floor(inches / 12).cast("string"), F.lit("-"), (inches % 12).cast("string")),
        "weight": (170 + 10 * (k % 11)).cast("string"),
        "draft_year": F.when(k % 5 == 0, "Undrafted").otherwise((1990 + k % 8).cast("string")),
        "draft_number": F.when(k % 5 == 0, "Undrafted").otherwise((k % 60 + 1).cast("string")),
    })


def team_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand-by-season totals: the team table."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), team_id_of("p_brand").alias("team_id"))
    lines = play_lines(spark, sf_dir).join(part, "l_partkey")
    return _derived(_season_sums(lines, ["team_id"])).drop("team_nation")


def team_id_of(brand: str):
    return F.element_at(F.split(F.col(brand), "#"), -1).cast("int")


def team_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three landed team tables: advanced, shooting and misc."""
    c = F.col
    div = F.try_divide
    box = cut_lineage(team_box(spark, sf_dir))  # read by all three
    advanced = box.select(
        "team_id", F.concat(F.lit("Team "), c("team_id").cast("string")).alias("team_name"), "season", "season_start",
        "w", "l", div(c("w"), c("w") + c("l")).alias("w_pct"), "gp",
        (div(c("fga"), c("min")) * 1000.0).alias("pace"), (div(c("pts"), c("fga")) * 100.0).alias("off_rating"),
        (div(c("w"), c("fga")) * 100.0).alias("def_rating"), div(c("pts"), 2.0 * (c("fga") + 0.44 * c("fta"))).alias("ts_pct"),
        div(c("fgm") + 0.5 * c("fg3m"), c("fga")).alias("efg_pct"), div(c("ast"), c("fgm")).alias("ast_pct"),
        div(c("ast"), c("tov")).alias("ast_to"), div(c("tov"), c("fga")).alias("tm_tov_pct"),
        div(c("oreb"), c("gp")).alias("oreb_pct"), div(c("dreb"), c("gp")).alias("dreb_pct"),
        div(c("reb"), c("gp")).alias("reb_pct"))
    shooting = box.select("team_id", "season", "fg3a", "fg3_pct", "fta", "fga", "fgm",
                          F.when(c("team_id") % 2 == 0, c("fga") - c("fg3a")).alias("paint_fga"))
    misc = box.select("team_id", "season", (c("fga") - c("fg3a")).alias("pts_paint"))
    return advanced, shooting, misc


def part_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part seasons as players of their brand's team."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player_id"), team_id_of("p_brand").alias("team_id"))
    return entity_seasons(spark, sf_dir, "part").join(part, "player_id").withColumn(
        "team", F.concat(F.lit("T"), F.col("team_id").cast("string")))
