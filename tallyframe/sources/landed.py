"""Landed files to tables: keyed JSON, header-and-rows JSON, prospect files, HTML pages, season partitions."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import clock_minutes, number, season_end_year, stat_number


# ---- parquet and partitions ----------------------------------------------------------------
def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Only the partitions present in `df` are replaced."""
    df.write.mode("overwrite").option("compression", "snappy").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def read_if_matching(spark: SparkSession, path: str, columns: list[str] | T.StructType) -> DataFrame | None:
    """A stored table, unless its columns (with a schema: their types too) are not exactly the expected ones; then it has to be rebuilt.
    Only a missing or empty folder counts as no table; other errors are the caller's."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    if isinstance(columns, T.StructType):
        have = {f.name: f.dataType for f in stored.schema.fields}
        return stored.select(*columns.names) if have == {f.name: f.dataType for f in columns.fields} else None
    return stored.select(*columns) if sorted(stored.columns) == sorted(columns) else None


def completed_seasons(stored: DataFrame | None, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "season string") if stored is None else stored.select("season").distinct()


def load_two_sources(required: DataFrame, optional: DataFrame | None, key: str, columns: list[str]) -> DataFrame:
    """Required totals with optional bio columns, one bio row per key; without a bio source they are null."""
    if optional is None:
        return required.withColumns({c: F.lit(None).cast("string") for c in columns})
    first = Window.partitionBy(key).orderBy(*columns)
    bio = optional.select(key, *columns).withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return required.join(bio, key, "left")


def conform(df: DataFrame, aliases: dict[str, str], texts: list[str], numbers: list[str]) -> DataFrame:
    """One projection to the expected columns: renamed aliases, defaults for missing ones, numbers coerced."""
    have = {c.lower(): c for c in df.columns}
    for old, new in aliases.items():
        if old.lower() in have and new.lower() not in have:
            have[new.lower()] = have[old.lower()]

    def column(name, default):
        return F.col(have[name.lower()]) if name.lower() in have else F.lit(default)

    return df.select(*[F.coalesce(column(c, "").cast("string"), F.lit("")).alias(c) for c in texts],
                     *[number(column(c, 0).cast("string")).alias(c) for c in numbers])


# ---- JSON ------------------------------------------------------------------------------------
def keyed_documents(texts: DataFrame, value_schema: str, text: str = "value") -> DataFrame:
    """{key: document} files, one row per entry."""
    return texts.select(F.explode(F.from_json(F.col(text), f"map<string,{value_schema}>")).alias("key", "doc"))


def read_keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    return keyed_documents(spark.read.text(path, wholetext=True), value_schema)


def write_keyed_json(df: DataFrame, path: str, key: str) -> None:
    """{key: document} files, one per partition, an entry a line; `read_keyed_json` reads them back. Rows without key are left out."""
    def written(batches):
        first = True
        for pdf in batches:
            lines = []
            for entry in pdf["entry"]:
                lines.append(("{" if first else ",") + entry)
                first = False
            yield pd.DataFrame({"value": lines})
        if not first:
            yield pd.DataFrame({"value": ["}"]})

    name = F.to_json(F.array(F.col(key).cast("string")))
    doc = F.to_json(F.struct(*[c for c in df.columns if c != key]))
    entries = df.where(F.col(key).isNotNull()).select(F.concat(F.regexp_extract(name, r"(?s)^\[(.*)\]$", 1), F.lit(": "), doc).alias("entry"))
    entries.mapInPandas(written, "value string").write.mode("overwrite").text(path)


def rowset_rows(payloads: DataFrame, text: str, columns: dict[str, str], ids: list[str]) -> DataFrame:
    """{resultSets: [{headers, rowSet}]} to rows: the first result set, columns by header, tolerant casts."""
    schema = "struct<resultSets:array<struct<headers:array<string>,rowSet:array<array<string>>>>>"
    first = F.get(F.from_json(F.col(text), schema)["resultSets"], F.lit(0))
    rows = payloads.select(*ids, first["headers"].alias("h"), F.explode(first["rowSet"]).alias("r"))
    named = rows.withColumn("m", F.map_from_arrays("h", "r"))
    return named.select(*ids, *[F.try_element_at("m", F.lit(c)).try_cast(t).alias(c.lower()) for c, t in columns.items()])


def prospect_files(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Class files in either shape, a wrapped object or a bare list; the class year comes from the file name, and from the
    wrapper where the name holds none."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    return prospect_records(texts, record)


def prospect_records(texts: DataFrame, record: str) -> DataFrame:
    wrapped = F.from_json(F.col("value"), f"struct<draft_class_year:int,prospects:array<{record}>>")
    listed = F.from_json(F.col("value"), f"array<{record}>")
    year = F.regexp_extract("file", r"prospects_(\d{4})\.json$", 1).try_cast("int")
    is_list = F.ltrim("value").startswith("[")
    return texts.select(F.coalesce(year, wrapped["draft_class_year"]).alias("class_year"),
                        F.explode(F.when(is_list, listed).otherwise(wrapped["prospects"])).alias("p")).select("class_year", "p.*")


# ---- HTML ------------------------------------------------------------------------------------
class _Tables(HTMLParser):
    """Rows of every table with the heading before it and the first link of each row."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.heading, self._open, self._cell, self._head = [], "", [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._open.append({"title": self.heading, "headers": [], "rows": []})
            self.tables.append(self._open[-1])
        elif tag in ("h1", "h2", "h3"):
            self._head = []
        elif self._open:
            table = self._open[-1]
            if tag == "tr":
                table["rows"].append([[], ""])
            elif tag in ("td", "th"):
                self._cell = (tag, [])
            elif tag == "a" and table["rows"] and not table["rows"][-1][1]:
                table["rows"][-1][1] = dict(attrs).get("href") or ""

    def handle_endtag(self, tag):
        if tag in ("h1", "h2", "h3") and self._head is not None:
            self.heading, self._head = " ".join("".join(self._head).split()), None
        elif tag == "table" and self._open:
            self._open.pop()
        elif tag in ("td", "th") and self._cell and self._open:
            kind, parts = self._cell
            text, table = " ".join("".join(parts).split()), self._open[-1]
            if kind == "th":
                table["headers"].append(text)
            elif table["rows"]:
                table["rows"][-1][0].append(text)
            self._cell = None

    def handle_data(self, data):
        if self._head is not None:
            self._head.append(data)
        if self._cell:
            self._cell[1].append(data)


def table_rows(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """All table rows of all pages. Pages are parsed where they lie, many at a time."""
    kind = pages.schema[page].dataType.simpleString()

    def parse(batches):
        for pdf in batches:
            out = []
            for pid, text in zip(pdf["page"], pdf["html"]):
                parser = _Tables()
                parser.feed(text or "")
                for t, table in enumerate(parser.tables):
                    out += [(pid, t, r, table["title"], table["headers"], cells, link) for r, (cells, link) in enumerate(table["rows"]) if cells]
            yield pd.DataFrame(out, columns=["page", "table_no", "row_no", "title", "headers", "cells", "link"])

    return pages.select(F.col(page).alias("page"), F.col(html).alias("html")).mapInPandas(
        parse, f"page {kind}, table_no int, row_no int, title string, headers array<string>, cells array<string>, link string")


def rows_with_headers(rows: DataFrame, required: list[str], columns: list[str]) -> DataFrame:
    """Rows of the first table per page that has all required headers, its cells by header."""
    fits = rows.where(F.size(F.array_except(F.array(*map(F.lit, required)), "headers")) == 0)
    # a window, as a join would parse all pages a second time
    first = F.min("table_no").over(Window.partitionBy("page"))
    n = F.least(F.size("headers"), F.size("cells"))
    named = fits.where("page is not null").withColumn("_first", first).where("table_no = _first").withColumn("m", F.map_from_arrays(F.slice("headers", 1, n), F.slice("cells", 1, n)))
    return named.select("page", "row_no", "title", "link", *[F.try_element_at("m", F.lit(c)).alias(c) for c in columns])


def profile_size(html: Column) -> dict[str, Column]:
    """Height and weight of a profile page."""
    return {"height": F.regexp_extract(html, r"(?i)<strong>Height:</strong>\s*([0-9]+-[0-9]+)", 1),
            "weight": F.regexp_extract(html, r"(?i)<strong>Weight:</strong>\s*([0-9]+)", 1)}


def profile_team(html: Column) -> Column:
    """First of the five team labels with a value, years in parentheses removed. A link's text is preferred."""
    values = []
    for label in ("Current Team:", "Current School:", "College:", "High School:", "Prep/High School:"):
        block = F.regexp_extract(html, rf"(?is)<p[^>]*>\s*<strong>[^<]*{label}[^<]*</strong>(.*?)</p>", 1)
        link = F.regexp_extract(block, r"(?is)<a[^>]*>(.*?)</a>", 1)
        plain = F.regexp_replace(F.when(link != "", link).otherwise(block), r"<[^>]+>", "")
        values.append(F.nullif(F.trim(F.regexp_replace(plain, r"\s*\(\d{4}\)", "")), F.lit("")))
    return F.coalesce(*values, F.lit(""))


def class_year(html: Column) -> Column:
    """Class year named on a page: three patterns in order, the first match of each, within 2007..2100."""
    def found(pattern):
        year = F.regexp_extract(html, pattern, 1).try_cast("int")
        return F.when(year.between(2007, 2100), year)

    return F.coalesce(*[found(p) for p in (r"(?i)(\d{4})\s+NBA\s+Draft", r"(?i)NBA\s+Draft\s+(\d{4})", r"(?i)(\d{4})\s+Draft\s+Prospects")])


def settled_class_year(scraped: Column, stored: Column, newest_done: Column) -> Column:
    """The stored year only moves forward; without either, the class after the newest finished one."""
    return F.coalesce(F.greatest(stored, scraped), newest_done + 1)


# fixed words: tables that hold no pre-draft seasons
LATER_TABLES = ("nba|summer league|preseason|play-in|playoff|rising stars|all-star|awards|transactions|experience|camp|high school|prep")


def pre_draft_rows(rows: DataFrame) -> DataFrame:
    """The season line a prospect is judged by. rows: player_id, draft_year, title, season, team, gp, min. The latest season up to
    the draft, totals and empty rows left out, 'All Teams' first and else the most minutes; an 'All Teams' line is named after
    the team with the most games."""
    rows = rows.where(~F.lower("title").rlike(LATER_TABLES) & ~F.upper("season").isin("CAREER", "TOTAL"))
    rows = rows.withColumns({"end_year": season_end_year(F.col("season")), "_min": clock_minutes(F.col("min")), "_gp": stat_number(F.col("gp"))})
    rows = rows.where(F.col("end_year") <= F.col("draft_year"))
    last = rows.groupBy("player_id").agg(F.max("end_year").alias("end_year"))
    usable = rows.join(last, ["player_id", "end_year"]).where((F.col("_gp") > 0) & (F.col("_min") > 0) & (F.col("_min") <= 50))
    usable = usable.withColumn("is_all", F.col("team").contains("All Teams"))
    w = Window.partitionBy("player_id").orderBy(F.col("is_all").desc(), F.col("_min").desc(), "team")
    best = usable.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    main = usable.where(~F.col("is_all")).groupBy("player_id").agg(F.max_by("team", F.struct("_gp", "team")).alias("_main"))
    return best.join(main, "player_id", "left").withColumn("team", F.when(F.col("is_all"), F.coalesce("_main", "team")).otherwise(F.col("team"))).drop(
        "_main", "is_all").withColumnsRenamed({"_min": "minutes", "_gp": "games"})
