"""Target-distribution importance resampling by overlapped regular-expression scanning.

Each text's bytes are lower-cased (A-Z), every run of separators becomes one space, and one scan with `finditer(overlapped=True)` finds the word at each place
together with the runs of words that begin there: look-arounds hold matches to whole words, and the spans of the groups are the n-grams, joined by one space as they
stand. Their CRC-32 modulo the number of buckets counts them. Documents are weighed by the mean log ratio of target and corpus frequencies of their buckets and drawn
without replacement by Gumbel scores: the highest scores are the sample.

Texts are scanned once; the sorted buckets of each document go to a stage (two bytes a feature), from which corpus counts and, with the gains known, weights are
read. Counts leave a task as at most one row a bucket. Ranks come from a range sort with offsets a partition, so no task holds all rows.

Null and empty texts have no features and weight 0; they and short texts are scored but not drawn. Equal scores are ordered by doc_id (null first), then by
number of features and weight: rows alike in all are interchangeable. An empty table gives no rows; an empty target's frequencies are the smoothing alone. Very long texts
are scanned whole. Columns besides doc_id and text are ignored unless asked for; asked-for columns named as a result give way to the result."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.rows import byte_map, columns_ddl, small_batches
from tallyframe.session import cut_lineage

RESULTS = ("n_features", "weight", "score", "rank")
_LEAST_LOG = 1000


def word_runs(longest: int) -> regex.Pattern:
    """A word with up to longest - 1 more behind it; group k ends where a run of k words does."""
    inner = b""
    for _ in range(longest - 1):
        inner = rb"(?: ([^ ]+)" + inner + rb")?"
    return regex.compile(rb"(?<![^ ])([^ ]+)" + inner + rb"(?![^ ])")


def _spaced() -> bytes:
    codes = byte_map("alnum")
    return bytes(32 if c == 0 else int(c) - 1 for c in codes)


def feature_buckets(text: bytes, runs: regex.Pattern, buckets: int, spaced: bytes) -> tuple[np.ndarray, int]:
    """(buckets of all runs of words in a text, number of words)."""
    words = text.translate(spaced).split()
    line = b" ".join(words)
    crc, groups = zlib.crc32, range(1, runs.groups + 1)
    out = []
    for m in runs.finditer(line, overlapped=True):
        start = m.start()
        for k in groups:
            end = m.end(k)
            if end < 0:
                break
            out.append(crc(line[start:end]))
    return np.array(out, np.uint32) % np.uint32(buckets), len(words)


def counted_features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """docs (text, kept columns) as a stage: kept columns, n_words, n_features and the differences of the sorted buckets."""
    small_batches(docs.sparkSession)
    kept, kind = list(keep), "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, spaced = word_runs(longest), _spaced()
        for batch in batches:
            words, n, packed = [], [], []
            for text in batch.column("_text").to_pylist():
                found, w = feature_buckets(text or b"", runs, buckets, spaced)
                words.append(w)
                n.append(len(found))
                packed.append(np.diff(np.sort(found), prepend=np.uint32(0)).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())],
                                             names=[*kept, "n_words", "n_features", "_buckets"])

    rows = docs.select(*kept, F.col("text").cast("binary").alias("_text"))
    return cut_lineage(rows.mapInArrow(run, columns_ddl(docs, kept, "n_words long, n_features long, _buckets binary")))


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, kind), dtype=np.int64)


def bucket_totals(counted: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) over all rows of `counted_features`."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column("_buckets").to_pylist():
                at, n = np.unique(_unpacked(data, kind), return_counts=True)
                total[at] += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    return counted.select("_buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Thousandths of the log ratio of smoothed frequencies, by bucket; both tables (bucket, n)."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    counts = np.zeros((2, buckets))
    for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():  # at most one row a bucket
        counts[:, r["bucket"]] = r["s"], r["t"]
    s, t = counts
    return np.floor(_LEAST_LOG * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(counted: DataFrame, gains: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, n_words, n_features, weight): the mean gain of a document's features, rounded down."""
    kept, kind = [*keep, "n_words", "n_features"], "<u2" if len(gains) <= 1 << 16 else "<u4"
    known = counted.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(known.value[_unpacked(data, kind)].sum()) // n if n else 0 for data, n in zip(batch.column("_buckets").to_pylist(), batch.column("n_features").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(weights, pa.int64())], names=[*kept, "weight"])

    return counted.select(*kept, "_buckets").mapInArrow(run, columns_ddl(counted, kept, "weight long"))


def resampled(docs: DataFrame, target: DataFrame, seed: int = 7, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) and target (text) -> doc_id, kept columns, n_features, weight, score, rank. `percent` of the documents of at least `least_words` words are
    drawn, rank 1 first; the others' rank is null."""
    kept = ("doc_id", *(c for c in dict.fromkeys(keep) if c not in (*RESULTS, "doc_id", "n_words", "_text", "_buckets")))
    counted = counted_features(docs, kept, longest, buckets)
    aim = bucket_totals(counted_features(target, (), longest, buckets), buckets)
    rows = weighed(counted, bucket_gains(bucket_totals(counted, buckets), aim, buckets), kept)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(-_LEAST_LOG * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = rows.withColumn("score", F.col("weight") + luck)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_first(), "n_features", "weight"]
    able = F.col("n_words") >= least_words
    ordered = cut_lineage(rows.orderBy(F.when(able, 0).otherwise(1), *order).select("*", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"], r["able"]) for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if(able).alias("able")).collect())
    before, at = [], 0
    for p, n, _ in sizes:
        before.append((p, at))
        at += n
    drawn = percent * sum(a for *_, a in sizes) // 100
    offsets = F.broadcast(ordered.sparkSession.createDataFrame(before, "_part long, _before long"))  # one row a partition
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = ordered.join(offsets, part == F.col("_part"), "left")
    return out.select(*kept, "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
