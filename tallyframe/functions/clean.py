"""Text and label cleaning as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..preset import POSITION_GROUPS, POSITION_WORDS

# Thresholds are compared with this margin so that engines summing in another order agree.
MARGIN = 1e-9


def above(c: Column, t: float) -> Column:
    return c > F.lit(t + MARGIN)


def below(c: Column, t: float) -> Column:
    return c < F.lit(t - MARGIN)


def at_least(c: Column, t: float) -> Column:
    return c >= F.lit(t - MARGIN)


def at_most(c: Column, t: float) -> Column:
    return c <= F.lit(t + MARGIN)


def number(c: Column, default: float | None = 0.0) -> Column:
    """Text or number to double; anything unreadable, NaN included, becomes the default."""
    value = c.try_cast("double")
    value = F.when(F.isnan(value), None).otherwise(value)
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    value = F.try_divide(a, b)
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


# ---- positions, sizes -------------------------------------------------------
def normalize_position(c: Column) -> Column:
    text = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.try_element_at(literal_map(POSITION_WORDS), text), text)


def position_group(c: Column) -> Column:
    text = normalize_position(c)
    parts = F.split(text, "-")
    whole = [F.when(text.isin(*v), g) for g, v in POSITION_GROUPS.items()]
    partly = [
        F.when(F.arrays_overlap(parts, F.array(*map(F.lit, v))), g)
        for g, v in POSITION_GROUPS.items()
    ]
    return F.coalesce(*whole, *partly, F.lit("W"))


def height_inches(c: Column, default: float = 0.0) -> Column:
    """'6-7', 6'7, 6/7 or a number of inches; unreadable heights give the default."""
    text = F.trim(c.cast("string"))

    def feet_inches(sep: str) -> Column:
        parts = F.split(text, sep)
        feet = F.trim(F.get(parts, F.lit(0))).try_cast("double")
        inches = F.trim(F.regexp_replace(F.get(parts, F.lit(1)), '"', "")).try_cast("double")
        return feet * 12.0 + inches

    plain = text.try_cast("double")
    return F.coalesce(plain, *[feet_inches(s) for s in ("-", "'", '"', "/")], F.lit(float(default)))


def weight_pounds(c: Column, default: float = 220.0) -> Column:
    return number(F.trim(c.cast("string")), default)


def height_bucket(inches: Column) -> Column:
    return (
        F.when(inches <= 0, "wing")
        .when(inches < 76, "guard")
        .when(inches <= 80, "wing")
        .when(inches < 84, "big")
        .otherwise("center")
    )


def draft_value(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    whole = text.try_cast("double").try_cast("bigint")
    return (
        F.when(c.isNull() | (c.cast("string") == ""), None)
        .when(F.lower(text).isin("undrafted", "nan", "none"), "Undrafted")
        .otherwise(F.coalesce(whole.cast("string"), text))
    )


# ---- seasons ----------------------------------------------------------------
def season_label(year: Column) -> Column:
    return F.concat(
        year.cast("string"), F.lit("-"), F.lpad(F.pmod(year + 1, F.lit(100)).cast("string"), 2, "0")
    )


def season_start(c: Column) -> Column:
    return F.get(F.split(c, "-"), F.lit(0)).try_cast("int")


def normalize_season(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^\d{4}-\d{2}$"), text).when(
        text.rlike(r"^\d{4}$"), season_label(text.try_cast("int"))
    )


def season_for_class(year: Column) -> Column:
    return season_label(year - 1)


def class_for_season(c: Column) -> Column:
    return F.substring(c, 1, 4).try_cast("int") + 1


def season_end_year(c: Column) -> Column:
    """End year of a season label. '1999-00' gives 1900: the century is taken from the start year."""
    text = F.regexp_replace(c.cast("string"), "[^0-9-]", "")
    parts = F.split(text, "-")
    first = F.get(parts, F.lit(0)).try_cast("int")
    second = F.get(parts, F.lit(1))
    two_digit = (F.floor(first / 100) * 100 + second.try_cast("int")).cast("int")
    return F.when(
        F.size(parts) == 2,
        F.when(first.isNotNull(), F.when(F.length(second) == 2, two_digit).otherwise(second.try_cast("int"))),
    ).when(F.size(parts) == 1, first)


def season_decade(c: Column) -> Column:
    return F.concat((F.floor(season_start(c) / 10) * 10).cast("string"), F.lit("s"))


def normalize_era(c: Column) -> Column:
    text = F.lower(F.trim(c))
    text = F.when(text.endswith("s"), text).otherwise(F.concat(text, F.lit("s")))
    # fixed values: short and long decade names
    names = {"90s": "1990s", "00s": "2000s", "10s": "2010s", "20s": "2020s"}
    return F.coalesce(F.try_element_at(literal_map(names), text), text)


def is_valid_era(c: Column) -> Column:
    return normalize_era(c).isin("1990s", "2000s", "2010s", "2020s")


def career_era(span: Column) -> Column:
    """Bucket of the midpoint of 'YYYY-YY to YYYY-YY'; unreadable spans count as the 2010s."""
    ends = F.split(span, " to ")
    first = season_start(F.get(ends, F.lit(0)))
    last = season_start(F.element_at(ends, -1))
    mid = (first + last) / 2.0
    # fixed values: bucket bounds
    return (
        F.when(mid.isNull(), "2010s")
        .when(mid < 2001, "late-90s")
        .when(mid < 2006, "early-2000s")
        .when(mid < 2011, "late-2000s")
        .when(mid < 2016, "early-2010s")
        .when(mid < 2021, "late-2010s")
        .otherwise("2020s")
    )


def season_spine(spark, first: int, last: int):
    years = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("season_start"))
    return years.withColumn("season", season_label(F.col("season_start")))


# ---- names ------------------------------------------------------------------
def _accent_table() -> tuple[str, str]:
    source, target = [], []
    for code in range(0xC0, 0x1F00):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accent_table()


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{M}", "")


def clean_name(c: Column) -> Column:
    text = F.regexp_replace(strip_accents(c), r"[.,]", "")
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def search_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def match_name(c: Column) -> Column:
    return search_name(strip_accents(c))


def slug(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(text == "", "unknown").otherwise(text)


def label_parts(c: Column) -> Column:
    """'A. One - B. Two' to its trimmed, non-blank parts."""
    return F.filter(F.transform(F.split(c, " - "), lambda x: F.trim(x)), lambda x: x != "")


def distinct_labels(labels: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x != ""))


# ---- per-game minutes, alternatives ------------------------------------------
def clock_minutes(c: Column) -> Column:
    """'mm:ss' or a number to minutes."""
    text = F.trim(c.cast("string"))
    parts = F.split(text, ":")
    clock = F.get(parts, F.lit(0)).try_cast("double") + F.get(parts, F.lit(1)).try_cast("double") / 60.0
    return F.coalesce(F.when(F.size(parts) == 2, clock), text.try_cast("double"), F.lit(0.0))


def stat_number(*alternatives: Column) -> Column:
    """First alternative that is present and not zero, as a double; '-' and blanks count as absent."""
    values = [
        F.when(F.trim(c.cast("string")).isin("", "-"), None).otherwise(
            F.nullif(F.trim(c.cast("string")).try_cast("double"), F.lit(0.0))
        )
        for c in alternatives
    ]
    return F.coalesce(*values, F.lit(0.0))
