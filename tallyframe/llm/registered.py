"""Registered queries of this subpackage, each over the whole of its tables, and SQL where it can say the same."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import sql
from tallyframe.llm.decontaminate import found_phrases
from tallyframe.llm.jaccard import jaccard_components
from tallyframe.llm.language import fitted, identified_languages, remainder
from tallyframe.llm.packing import packed
from tallyframe.llm.planes import read_ids, write_ids
from tallyframe.llm.quality import judged
from tallyframe.llm.quotes import as_mail, linked
from tallyframe.llm.repair import damaged, repaired
from tallyframe.llm.repeats import without_repeats
from tallyframe.llm.resample import resampled
from tallyframe.llm.rollups import Rollup, counted, new_folder
from tallyframe.llm.rows import identified, small_batches, table, with_ids
from tallyframe.llm.toxicity import fitted as fitted_toxicity
from tallyframe.llm.toxicity import remainder as toxicity_remainder
from tallyframe.llm.toxicity import scored
from tallyframe.llm.urls import judged_urls
from tallyframe.session import checkpoint_dir, cut_lineage


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = identified_languages(docs, fitted(docs))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_curve_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = identified(table(spark, sf, "documents"), "doc_id", "text")
    return with_ids(docs, packed(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op3_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return judged_urls(table(spark, sf, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = identified(table(spark, sf, "documents"), "doc_id", "text")
    return with_ids(docs, jaccard_components(docs), "component").withColumnRenamed("component", "component_id")


def op5_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = identified(table(spark, sf, "documents"), "doc_id", "text")
    found = found_phrases(docs, table(spark, sf, "benchmark"), carry=("doc_id",))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end_word"] - x["first_word"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = identified(table(spark, sf, "documents"), "doc_id", "text")
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return without_repeats(docs, carry=("doc_id",)).select(
        "doc_id", (removed + F.octet_length("kept")).alias("n_bytes"), removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op7_bit_plane_output(spark: SparkSession, sf: str) -> DataFrame:
    docs = identified(table(spark, sf, "documents"), "doc_id", "text")
    folder, manifest = write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return with_ids(docs, read_ids(folder, manifest).drop("ids"))


def op8_quotation_linking(spark: SparkSession, sf: str) -> DataFrame:
    """Over all conversations, each message as a reply by mail that quotes the message before it (the table itself holds no quotations)."""
    messages = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return linked(as_mail(messages))


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    out = judged(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_rollups(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is inserted in four batches, one of which comes twice; then every count is revised to hold an end id, and later copies of
    a text are deleted."""
    small_batches(spark)
    version = "byte_bpe_50k"
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source").withColumn("digest", F.md5(F.encode("text", "UTF-8")))
    rows = cut_lineage(counted(docs, public_tokenizers.path(f"{version}.json"), True, ("doc_id", "digest", "lang", "source")))
    first = rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = rows.join(first.select("digest", "first"), "digest").filter("doc_id <> first")
    none = F.lit(None).cast("long")

    def changes(of: DataFrame, kind: str, tokens, old=none) -> DataFrame:
        return of.select(F.lit(kind).alias("kind"), "source", "lang", F.lit(version).alias("tokenizer"), tokens.alias("tokens"), old.alias("old_tokens"))

    store = Rollup(spark, new_folder(checkpoint_dir(spark)))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    for k in (0, 1, 2, 3, 1):
        store.commit(f"load-{k}", changes(rows.filter(part == k), "insert", F.col("tokens")))
    store.commit("end-id", changes(rows, "revise", F.col("tokens") + 1, F.col("tokens")))
    store.commit("copies", changes(copies, "delete", F.col("tokens") + 1))
    return store.totals()


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation damaged, then repaired; those of which no row is left have zeros."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    out = rows.select("conv_id").distinct().alias("i").join(repaired(damaged(rows)).alias("r"), F.expr("i.conv_id <=> r.conv_id"), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("i.conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = scored(docs, fitted_toxicity(docs, table(spark, sf, "labels")))
    held_out = F.coalesce(toxicity_remainder(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op13_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampled(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("text"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


Q = {f.__name__: f for f in (op1_language_id, op2_curve_packing, op3_url_filters, op4_ngram_jaccard_join, op5_benchmark_decontamination, op6_suffix_array_dedup, op7_bit_plane_output, op8_quotation_linking, op9_quality_rules, op10_token_rollups,
                           op11_conversation_repair, op12_toxicity, op13_importance_resampling, pipeline)}
O = {"op3_url_filters": sql.OP3, "op4_ngram_jaccard_join": sql.OP4, "op5_benchmark_decontamination": sql.OP5, "op6_suffix_array_dedup": sql.OP6, "op9_quality_rules": sql.OP9,
     "op11_conversation_repair": sql.OP11, "op13_importance_resampling": sql.OP13}
