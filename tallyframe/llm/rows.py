"""Row identity, stage tables, and texts as byte buffers for tasks that work with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

#: Arrow batches of few rows: a batch of very long texts must fit a worker.
BATCH_ROWS = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def columns_ddl(docs: DataFrame, kept: list[str] | tuple[str, ...], more: str) -> str:
    """Schema text of kept columns and more."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields), more])


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def identified(docs: DataFrame, id_column: str, text_column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(uid, doc_id, text, kept columns): uid is a distinct long in the order of the ids. Where ids are unique and not
    null, uid is the id (and a column _same says so). Else the rows are sorted (null ids first, equal ids by a hash of the text) and uid is the place
    in that order, written to the shared folder so that it never changes."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), *keep)
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids")).first()
    if seen["n"] == seen["ids"] and rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows.select(F.col("doc_id").alias("uid"), "*", F.lit(True).alias("_same"))
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return cut_lineage(ordered.select(F.monotonically_increasing_id().alias("uid"), "*"))


def with_ids(docs: DataFrame, result: DataFrame, *references: str) -> DataFrame:
    """The result of an operator with doc_id for uid, and for the uids in the columns `references`."""
    if all(f.name != "_same" for f in docs.schema.fields):
        ids = docs.select("uid", "doc_id")
        out = result.join(ids, "uid").drop("uid")
        for c in references:
            out = out.join(ids.select(F.col("uid").alias(c), F.col("doc_id").alias("_id")), c).drop(c).withColumnRenamed("_id", c)
        return out
    return result.withColumnRenamed("uid", "doc_id")


def text_groups(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with about `most` text bytes (one text at least): (slice, bytes of its texts end to end, n + 1 offsets).
    A null text has no bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if pa.types.is_null(col.type):
            col = col.cast(pa.string())
        if col.null_count:
            col = pa.compute.fill_null(col, "")
        wide = pa.types.is_large_string(col.type)
        offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            to = min(to, len(col))
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


class Words:
    """Words of texts and their 64-bit hashes. A word is a maximal run of bytes that `letters` maps to something else than 0."""

    def __init__(self, letters: np.ndarray):
        self.letters = letters
        self.codes = np.random.RandomState(20240607).randint(1, 2**63 - 1, 257, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self._power = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._power) < n:
            size = max(n, 1 << 16)
            odd = 0x9E3779B97F4A7C15
            for name, base in (("_power", odd), ("_inverse", pow(odd, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self._power[:n], self._inverse[:n]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of values times powers; with `window` the hash of any stretch."""
        power, _ = self.powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=out[1:])
        return out

    def window(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, inverse = self.powers(len(sums))
        return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start byte, end byte, hash, text number) of each word; words never cross texts."""
        b = self.letters[data]
        inside = b != 0
        first = np.zeros(len(b) + 1, bool)
        first[offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:-1]
        start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        hashes = self.window(self.sums(self.codes[b]), start, end)
        return start, end, hashes, np.searchsorted(offsets, start, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finisher: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_map(words: str, lower: bool = True) -> np.ndarray:
    """Codes of the bytes of words ("space": all but white space; "alnum": ASCII letters, digits and all beyond ASCII), others 0; A-Z as a-z."""
    out = np.arange(1, 257, dtype=np.uint16)
    if lower:
        out[65:91] += 32
    drop = [0x20, *range(9, 14)] if words == "space" else [b for b in range(128) if not chr(b).isalnum()]
    out[drop] = 0
    return out


def bitmap_filter(rows: DataFrame, key: str, ids: DataFrame, bits: int = 1 << 22, apart: bool = False):
    """Rows whose key may be in the one column of `ids`: a bitmap of fixed size (half a megabyte) is broadcast, so that a following exact
    join shuffles little. It lets a few others through, and all of them once ids outnumber its bits. `apart`: also the rows surely not among them."""
    name = ids.columns[0]
    place = F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(32)).cast("int"))
    words = ids.select(F.floor(place / 32).alias("_word"), bit.alias("_bit"))
    words = words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    words = cut_lineage(words) if apart else words
    own = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bits))
    marked = rows.withColumn("_at", own)
    joined = marked.join(F.broadcast(words), F.floor(F.col("_at") / 32) == F.col("_word"), "left" if apart else "inner")
    bit_set = F.coalesce(F.expr("shiftright(_bits, cast(pmod(_at, 32) as int)) & 1 = 1"), F.lit(False))
    found = joined.filter(bit_set).select(*rows.columns)
    return (found, joined.filter(~bit_set).select(*rows.columns)) if apart else found


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of `edges` (a, b): label is the smallest node reachable. Each round every node goes to its
    smallest neighbour and the edges are contracted; the rounds are about the logarithm of the longest path."""
    both = edges.select("a", "b").filter("a <> b").distinct()
    label = None
    while True:
        both = cut_lineage(both)
        if both.isEmpty():
            break
        ways = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut_lineage(ways.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        if label is None:
            label = step.select("node", F.col("to").alias("label"))
        else:
            onward = step.select(F.col("node").alias("label"), "to")
            label = label.join(onward, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        label = cut_lineage(label)
        a, b = (step.select(F.col("node").alias(x), F.col("to").alias(f"_{x}")) for x in "ab")
        both = both.join(a, "a").join(b, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).filter("a <> b").distinct()
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    return label
