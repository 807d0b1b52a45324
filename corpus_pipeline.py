"""From documents to packed sequences, in stages. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.decontaminate import found_phrases, without_spans
from tallyframe.llm.jaccard import jaccard_components
from tallyframe.llm.packing import packed
from tallyframe.llm.quality import WORD_REACH, judged
from tallyframe.llm.repeats import without_repeats
from tallyframe.llm.rows import bitmap_filter, identified, table, with_ids
from tallyframe.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REST = ("lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and those without the common words of their language."""
    return judged(docs.select(*COLUMNS), {"word_reach": WORD_REACH}).filter("kept").select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays; documents without shingles all stay."""
    rows = identified(docs, "doc_id", "text", REST)
    others = cut_lineage(jaccard_components(rows).filter("uid <> component").select("uid"))
    some, rest = bitmap_filter(rows, "uid", others, apart=True)
    return some.join(others, "uid", "left_anti").unionByName(rest).select(*COLUMNS)


def _shortened(rows: DataFrame, text, changed) -> DataFrame:
    """The changed texts in place of the old ones; documents of which no word is left go."""
    out = rows.withColumn("text", F.when(changed, text).otherwise(F.col("text"))).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.filter(~changed | F.col("text").rlike(r"[^\s]")).select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated stretches go; a character cut in two goes as well."""
    rows = identified(docs, "doc_id", "text", REST)
    cut = without_repeats(rows, carry=("doc_id", "text", *REST))
    kept = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    return _shortened(cut, kept, F.size("removed") > 0)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark phrases go, with what stands between them."""
    rows = identified(docs, "doc_id", "text", REST)
    found = found_phrases(rows, table(spark, sf_dir, "benchmark"), carry=("doc_id", "text", *REST))
    return _shortened(found, without_spans("text", "spans"), F.size("spans") > 0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = identified(docs, "doc_id", "text")
    return with_ids(rows, packed(rows, public_tokenizers.path("byte_bpe_50k.json")).drop("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

ORACLE_SQL = None  # SQL cannot run the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        rows = cut_lineage(stage(spark, rows, sf_dir))
    return rows
