"""Packing along a space-filling curve.

A document's token counts are hashed into buckets and projected to a few dimensions; its place on the Hilbert curve through
that space is its key. Documents are range-sorted by key (equal keys by id), laid end to end, and cut into sequences, so that
a sequence holds neighbours. Only the last tokens of all do not fill a sequence; they go into sequences whose lengths are powers of
two, which need no padding. Texts are encoded once; the sort moves keys and counts only, and the ids move once, to their places.

Null texts are empty: they still have the end id. Equal ids are told apart by `identified`; an empty table gives no rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.rows import mixed
from tallyframe.llm.tokens import forget, token_ids
from tallyframe.session import cut_lineage

LENGTH = 2048
END = 1
BUCKETS = 1024
DIMENSIONS = 4
BITS = 12


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of rows of unsigned coordinates below 2**bits (Skilling's transposition)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curve:
    """Keys from token ids."""

    def __init__(self, vocabulary: int):
        self.bucket = (mixed(np.arange(vocabulary, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
        self.axes = np.random.RandomState(17).standard_normal((BUCKETS, DIMENSIONS))

    def place(self, ids: np.ndarray) -> np.ndarray:
        counts = np.bincount(self.bucket[ids], minlength=BUCKETS)
        at = counts @ self.axes / max(1.0, np.sqrt((counts.astype(float) ** 2).sum()))
        return ((np.tanh(at / 2) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)


def _encoded(path: str, space_joins: bool, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = token_ids(path, space_joins)
        curve = Curve(coder.tokenizer.get_vocab_size())
        stop = np.array([end], coder.dtype).tobytes()
        for batch in batches:
            ids = [b + stop for b in coder.encode([t or "" for t in batch.column("text").to_pylist()])]
            places = np.array([curve.place(np.frombuffer(b, coder.dtype)) for b in ids]).reshape(-1, DIMENSIONS)
            counts = [len(b) // coder.dtype.itemsize for b in ids]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(hilbert(places), pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                                             names=["uid", "key", "n_tokens", "ids"])

    return run


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    at = 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        if len(n):
            end = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("part"), pa.array(end - n), pa.array(n)], names=["uid", "part", "local", "n_tokens"])
            at = int(end[-1])


def _pieces(length: int, total: int, ids_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        whole = total - total % length
        tail = [whole]  # where the last sequences begin
        for bit in range(length.bit_length(), -1, -1):
            if (total - whole) >> bit & 1:
                tail.append(tail[-1] + (1 << bit))
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("uid", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for uid, at, n, data in zip(*(batch.column(c).to_pylist() for c in ("uid", "at", "n_tokens", "ids"))):
                ids = np.frombuffer(data, f"<u{len(data) // n}").astype("<u4")  # n counts the end id, so it is never 0
                done = 0
                while done < len(ids):
                    g = at + done
                    if g < whole:
                        number, first, last = g // length, g - g % length, g - g % length + length
                    else:
                        k = int(np.searchsorted(tail, g, "right")) - 1
                        number, first, last = whole // length + k, tail[k], tail[k + 1]
                    take = min(len(ids) - done, last - g)
                    piece = ids[done : done + take].tobytes()
                    for c, v in zip(rows, (uid, done, take, zlib.crc32(piece), len(ids), number, g - first, piece if ids_too else None)):
                        rows[c].append(v)
                    done += take
            arrays = [pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in rows.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=list(rows))

    return run


def packed(docs: DataFrame, tokenizer: str, space_joins: bool = True, end: int = END, length: int = LENGTH, ids_too: bool = False) -> DataFrame:
    """docs (uid, text) -> pieces (uid, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids); ids (unsigned 32-bit,
    little-endian) are null unless `ids_too`. `length` is a power of two."""
    coded = cut_lineage(docs.select("uid", "text").mapInArrow(_encoded(tokenizer, space_joins, end), "uid long, key long, n_tokens long, ids binary"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.select("uid", "key", "n_tokens").repartitionByRange(partitions, "key", "uid").sortWithinPartitions("key", "uid")
    laid = cut_lineage(ordered.select("uid", "n_tokens", F.spark_partition_id().alias("part")).mapInArrow(_laid, "uid long, part int, local long, n_tokens long"))
    sums = laid.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row for each partition
    begins, total = [], 0
    for r in sums:
        begins.append((r["part"], total))
        total += r["n"]
    offsets = docs.sparkSession.createDataFrame(begins, "part int, begin long")
    places = laid.join(F.broadcast(offsets), "part").select("uid", (F.col("begin") + F.col("local")).alias("at"), "n_tokens")
    schema = "uid long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return coded.select("uid", "ids").join(places, "uid").mapInArrow(_pieces(length, total, ids_too), schema)
