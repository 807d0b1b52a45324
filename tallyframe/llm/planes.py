"""Token-id files of transposed planes.

A shard file holds the ids of consecutive documents in blocks of fixed size. A block's ids are transposed into byte planes (all lowest bytes, then
the next) or bit planes, each compressed with zstandard on its own, so that planes without information cost nothing. Behind the blocks stand
the chunk index (place, ids and plane sizes of each block), the documents' ids and counts, and the index's length: a reader fetches the end
of the file and then only the blocks it needs.

Documents are range-sorted by id; each partition writes its file under a passing name and renames it, so a repeated task leaves
the same file. Null texts are empty: they have the end id only. Equal ids are told apart by `identified`."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.tokens import token_ids
from tallyframe.session import checkpoint_dir, cut_lineage

MAGIC = b"IDPL0001"
BLOCK = 1 << 16
SHARD_BYTES = 24 << 20


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    cells = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [np.ascontiguousarray(cells[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(cells, axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(bits[:, k]), bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)).view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u4").ravel()


def shard_bytes(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, mode: str = "byte", block: int = BLOCK) -> bytes:
    coder, out, at, index = zstandard.ZstdCompressor(level=3), [MAGIC], len(MAGIC), []
    for first in range(0, len(ids), block):
        part = ids[first : first + block]
        planes = [coder.compress(p) for p in to_planes(part, mode)]
        index.append([at, len(part), [len(p) for p in planes]])
        out += planes
        at += sum(map(len, planes))
    docs = coder.compress(doc_ids.astype("<i8").tobytes() + counts.astype("<i8").tobytes())
    tail = coder.compress(json.dumps({"mode": mode, "block": block, "ids": len(ids), "docs": len(counts), "chunks": index}).encode())
    return b"".join([*out, docs, tail, struct.pack("<QQ", len(docs), len(tail)), MAGIC])


class Shard:
    """Reads a shard file; `file` is a seekable binary file."""

    def __init__(self, file):
        self.file, self.coder = file, zstandard.ZstdDecompressor()
        size = file.seek(0, 2)
        file.seek(size - 24)
        end = file.read(24)
        if end[16:] != MAGIC:
            raise ValueError("not a token-id shard")
        docs, tail = struct.unpack("<QQ", end[:16])
        file.seek(size - 24 - tail - docs)
        body = file.read(docs + tail)
        self.index = json.loads(self.coder.decompress(body[docs:]))
        table = np.frombuffer(self.coder.decompress(body[:docs]), "<i8")
        self.doc_ids, self.counts = table[: self.index["docs"]], table[self.index["docs"] :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the shard; only their blocks are read."""
        block, out = self.index["block"], []
        for k in range(start // block, -(-stop // block)):
            at, n, sizes = self.index["chunks"][k]
            self.file.seek(at)
            body, cut, planes = self.file.read(sum(sizes)), 0, []
            for s in sizes:
                planes.append(self.coder.decompress(body[cut : cut + s]))
                cut += s
            out.append(from_planes(planes, n, self.index["mode"])[max(0, start - k * block) : stop - k * block])
        return np.concatenate(out) if out else np.empty(0, "<u4")


def _opened(folder: str):
    return fs.FileSystem.from_uri(folder)


def _written(folder: str, tokenizer: str, space_joins: bool, end: int, mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = token_ids(tokenizer, space_joins)
        stop = np.array([end], coder.dtype).tobytes()
        uids, counts, bodies, part = [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            got = [b + stop for b in coder.encode([t or "" for t in batch.column("text").to_pylist()])]
            uids.append(batch.column("uid").to_numpy())
            counts.append(np.array([len(b) // coder.dtype.itemsize for b in got], np.int64))
            bodies.append(b"".join(got))
        if part is None:
            return
        ids = np.frombuffer(b"".join(bodies), coder.dtype)
        counts = np.concatenate(counts)
        data = shard_bytes(ids, np.concatenate(uids), counts, mode)
        where, base = _opened(folder)
        name = f"ids-{part:06d}.planes"
        passing = f"{base}/_{name}.{uuid.uuid4().hex}"
        with where.open_output_stream(passing) as out:
            out.write(data)
        where.move(passing, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(counts)], pa.int64()), pa.array([len(ids)], pa.int64())],
                                         names=["part", "file", "docs", "ids"])

    return run


def write_ids(docs: DataFrame, tokenizer: str, end: int, folder: str | None = None, space_joins: bool = False, mode: str = "byte") -> tuple[str, DataFrame]:
    """docs (uid, text) -> (folder, manifest (part, file, docs, ids, start)): files in the order of uid; start counts the ids before a file."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}-planes"
    where, base = _opened(folder)
    where.create_dir(base, recursive=True)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES))
    ordered = docs.select("uid", "text").repartitionByRange(partitions, "uid").sortWithinPartitions("uid")
    wrote = ordered.select("uid", "text", F.spark_partition_id().alias("part")).mapInArrow(
        _written(folder, tokenizer, space_joins, end, mode), "part int, file string, docs long, ids long")
    files, at, rows = cut_lineage(wrote).orderBy("part").collect(), 0, []  # one row for each file
    for r in files:
        rows.append((r["part"], r["file"], r["docs"], r["ids"], at))
        at += r["ids"]
    return folder, spark.createDataFrame(rows, "part int, file string, docs long, ids long, start long")


def read_ids(folder: str, manifest: DataFrame, ids_too: bool = False) -> DataFrame:
    """(uid, start, n_tokens, ids_crc32, ids) of each document, from the files; ids are null unless `ids_too`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _opened(folder)
        for batch in batches:
            for name, begin in zip(*(batch.column(c).to_pylist() for c in ("file", "start"))):
                with where.open_input_file(f"{base}/{name}") as file:
                    shard = Shard(file)
                    ends = np.cumsum(shard.counts)
                    for at in range(0, len(ends), 2048):
                        few = slice(at, at + 2048)
                        first = int(ends[at] - shard.counts[at])
                        ids = shard.ids(first, int(ends[few][-1])).astype("<u4")
                        cuts = np.concatenate([[0], ends[few] - first])
                        bodies = [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard.doc_ids[few]), pa.array(begin + first + cuts[:-1]), pa.array(shard.counts[few]),
                             pa.array([zlib.crc32(b) for b in bodies], pa.int64()), pa.array(bodies if ids_too else [None] * len(bodies), pa.binary())],
                            names=["uid", "start", "n_tokens", "ids_crc32", "ids"])

    files = max(1, manifest.count())
    return manifest.select("file", "start").repartition(files, "file").mapInArrow(run, "uid long, start long, n_tokens long, ids_crc32 long, ids binary")
