"""Draft classes from stored records: list, detail and meta.

Records come as JSON of no fixed shape: a metric may be an object with a value, a bare number, numeric text or missing, with raw totals beside it. They are read as
VARIANT, so a wrong shape is a null and no error. Percentiles are taken over all classes, current and past; a listed score is the record's own value held against
the pool of everyone of its height bucket. Of an id in several classes the current one counts, then the newest. A class holds an id once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import preset as P
from ..functions import scores
from ..functions.clean import height_bucket, height_inches
from ..operators import career as C
from ..operators.ranking import pct_le, with_percentiles
from ..operators.upserts import first_per_key
from ..session import cut_lineage

# fixed: the box score of a listed prospect, in this order
BOX_KEYS = ["ppg", "rpg", "apg", "spg", "bpg", "mpg", "gp", "fg_pct", "fg3_pct", "ft_pct"]
TEXTS = ["player_name", "team", "height", "weight", "role"]


def payload_records(payloads: DataFrame) -> DataFrame:
    """(current boolean, class_year, payload text) -> (current, class_year, record VARIANT). A payload is a list of records or an object that
    holds them as `prospects`, with its own `draft_class_year`; text that is no JSON gives none."""
    read = payloads.withColumn("_p", F.try_parse_json("payload"))
    rows = F.coalesce(F.try_variant_get("_p", "$.prospects", "array<variant>"), F.try_variant_get("_p", "$", "array<variant>"))
    year = F.coalesce(F.try_variant_get("_p", "$.draft_class_year", "int"), F.col("class_year"))
    return read.select("current", year.alias("class_year"), F.explode(rows).alias("record"))


def own_value(record: Column | str, name: str) -> Column:
    """The value of a metric stored as an object."""
    return F.try_variant_get(record, f"$.{name}.value", "double")


def metric_value(record: Column | str, name: str) -> Column:
    """The value of a metric in any shape; minutes fall back to the raw totals."""
    found = [own_value(record, name), F.try_variant_get(record, f"$.{name}", "double")]
    return F.coalesce(*found, F.try_variant_get(record, "$.raw_stats.mpg", "double")) if name == "mpg" else F.coalesce(*found)


def prospect_rows(records: DataFrame) -> DataFrame:
    """Typed columns: `<metric>` in any shape, `own_<metric>` only from an object, `raw_<box key>`."""
    text = lambda c: F.coalesce(F.try_variant_get("record", f"$.{c}", "string"), F.lit("")).alias(c)
    number = lambda path: F.try_variant_get("record", path, "double")
    games = F.coalesce(number("$.gp"), number("$.raw_stats.gp"), F.lit(0.0))
    return records.select(
        "current", "class_year", F.try_variant_get("record", "$.prospect_id", "string").alias("prospect_id"), *map(text, TEXTS),
        F.try_variant_get("record", "$.pick", "int").alias("pick"), games.alias("gp"), *[number(f"$.raw_stats.{k}").alias(f"raw_{k}") for k in BOX_KEYS],
        *[metric_value("record", m).alias(m) for m in P.PROSPECT_METRICS], *[own_value("record", m).alias(f"own_{m}") for m in P.PROSPECT_METRICS])


def _polished(pct: dict[str, Column], value) -> Column:
    return scores.impact_score(pct) * scores.prospect_damper(F.coalesce(value("mpg"), F.lit(0.0)), F.col("gp"), F.coalesce(value("ts_pct"), F.lit(0.0)))


def scored_classes(rows: DataFrame) -> DataFrame:
    """Every record of every class with `<metric>_pct` over the union of the classes, pfv, apfv and skill ratings. In the pool a metric that is
    missing counts as the lowest; in a record's own score one that is not stored as an object counts as the median."""
    df = rows.withColumn("record_key", F.concat_ws(":", F.coalesce(F.col("class_year").cast("string"), F.lit("")), F.col("current").cast("string"), "prospect_id"))
    df = cut_lineage(with_percentiles(cut_lineage(df), P.PROSPECT_METRICS, [], ["record_key"], "_pct", pct_le, default=0.0))
    own = {m: F.when(F.col(f"own_{m}").isNotNull(), F.col(f"{m}_pct")) for m in P.PROSPECT_METRICS}
    df = cut_lineage(df.withColumns({
        "pfv": scores.impact_score(own), "adjusted": _polished(own, lambda m: F.col(f"own_{m}")),
        "_pooled": _polished({m: F.col(f"{m}_pct") for m in P.PROSPECT_METRICS}, F.col), "height_bucket": height_bucket(height_inches(F.col("height")))}))
    pool = df.select("height_bucket", F.col("_pooled").alias("adjusted"))
    df = cut_lineage(C.curve_against_pool(df, pool, "adjusted", "height_bucket", "record_key").drop("_pooled"))
    return df.withColumns({f"{a}_rating": c for a, c in scores.skill_ratings(own, F.col("apfv")).items()})


def draft_list(scored: DataFrame, year: int | None = None, every: bool = False) -> DataFrame:
    """The list of the current class, or of a past one: bio, pick, score, box score with percentiles within the class, skill ratings. `every`: all lists."""
    rows = scored if every else scored.where("current") if year is None else scored.where((F.col("class_year") == year) & ~F.col("current"))
    raw = [f"raw_{k}" for k in BOX_KEYS]
    rows = C.class_box_percentiles(rows, raw, ["class_year", "current"], "record_key")
    box = F.map_from_arrays(F.array(*map(F.lit, BOX_KEYS)), F.array(*[
        F.struct(F.coalesce(F.col(c), F.lit(0.0)).alias("value"), F.coalesce(F.col(f"{c}_class_pct"), F.lit(0.0)).alias("percentile")) for c in raw]))
    return rows.select("current", "class_year", "prospect_id", *TEXTS, "pick", "apfv", box.alias("box_score"), _ratings())


def _ratings() -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, P.SKILL_AXES)), F.array(*[F.col(f"{a}_rating") for a in P.SKILL_AXES])).alias("skill_ratings")


def draft_detail(scored: DataFrame, prospect_id: str | None = None) -> DataFrame:
    """One record an id (or the one asked for): metrics stored as objects with their percentiles over all classes, raw totals with the fresh pfv and apfv, skill ratings."""
    rows = scored if prospect_id is None else scored.where(F.col("prospect_id") == prospect_id)
    chosen = first_per_key(rows, ["prospect_id"], [F.col("current").desc(), F.col("class_year").desc_nulls_last()])
    entries = [F.struct(F.lit(m).alias("key"), F.struct(F.col(f"own_{m}").alias("value"), F.col(f"{m}_pct").alias("percentile")).alias("value")) for m in P.PROSPECT_METRICS]
    metrics = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"]["value"].isNotNull()))
    totals = {**{k: F.col(f"raw_{k}") for k in BOX_KEYS}, "pfv": F.col("pfv"), "apfv": F.col("apfv")}
    raw = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, totals)), F.array(*totals.values())), lambda k, v: v.isNotNull())
    return chosen.select("prospect_id", "current", "class_year", *TEXTS, "pick", metrics.alias("metrics"), raw.alias("raw_stats"), _ratings())


def draft_meta(payloads: DataFrame, year_by_date: int) -> DataFrame:
    """One row: the current class's year (its own, else one past the newest past class, else the date's) and the past classes on record."""
    own = F.try_variant_get(F.try_parse_json("payload"), "$.draft_class_year", "int")
    past = F.when(~F.col("current"), F.col("class_year"))
    out = payloads.agg(F.max(F.when(F.col("current"), own)).alias("own"), F.max(past).alias("newest"), F.array_sort(F.collect_set(past)).alias("available_draft_years"))
    return out.select(F.coalesce("own", F.col("newest") + 1, F.lit(year_by_date)).alias("draft_class_year"), "available_draft_years")
