"""Session settings this library expects; a cluster's own settings always win."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def build_session(master: str | None = None, cores: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("tallyframe")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if cores:
        defaults["spark.sql.shuffle.partitions"] = str(cores)
    for name, value in {**defaults, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


TASK_ROWS = 250_000
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def spread_rows(spark: SparkSession, rows: int) -> None:
    """Let shuffles begin with a partition for every TASK_ROWS rows, so that what one task holds does not grow with the input. Adaptive
    execution joins small partitions again. Never fewer than now, and a number set by the cluster stays."""
    if spark.sparkContext.getConf().get(INITIAL, None) is None:
        now = int(spark.conf.get(INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))
        if (wanted := -(-rows // TASK_ROWS)) > now:
            spark.conf.set(INITIAL, str(wanted))


_local_dir: str | None = None


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder lineage is cut to. The cluster names it; only a local run gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    global _local_dir
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="tallyframe-")
    return _local_dir


_stages: list[str] = []
_passing: list[list[str] | None] = [None]

# a job's shuffle files go when it ends, not when the driver happens to collect its garbage
SHUFFLE_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there. The rows survive lost executors, every
    later branch reads them instead of computing them again, and reads only the columns it needs. The tables stay until
    `drop_stages`, those written on the way to one of `cut_built` until that is written. `group_bytes`: the most a row group holds, for `row_groups`."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    _stages.append(path)
    if _passing[-1] is not None:
        _passing[-1].append(path)
    before = spark.conf.get(SHUFFLE_FILES, None)
    spark.conf.set(SHUFFLE_FILES, "true")
    try:
        df.write.options(**{"parquet.block.size": group_bytes} if group_bytes else {}).parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_FILES) if before is None else spark.conf.set(SHUFFLE_FILES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


@contextmanager
def _tables(into: list[str] | None) -> Iterator[None]:
    _passing.append(into)
    try:
        yield
    finally:
        _passing.pop()


def cut_built(spark: SparkSession, build: Callable[[], DataFrame], group_bytes: int | None = None) -> DataFrame:
    """`cut_lineage` of the rows `build` returns. Nothing else may read the tables written on the way: they are deleted, but for those of `lasting`."""
    with _tables(made := []):
        rows = build()
    out = cut_lineage(rows, group_bytes)
    _delete(spark, made)
    return out


def lasting(build: Callable[[], T]) -> T:
    """What `build` returns, with all tables it writes kept until `drop_stages`."""
    with _tables(None):
        return build()


def release(*tables: DataFrame) -> None:
    """Delete tables of `cut_lineage` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, [t.stage_path])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        if path in _stages:
            _stages.remove(path)
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stages(spark: SparkSession) -> int:
    """Delete the tables this process has written by `cut_lineage`, once all results that read them are stored. Returns their number."""
    paths = list(_stages)
    _delete(spark, paths)
    return len(paths)


def cut_files(df: DataFrame, count: int, *order: str) -> tuple[DataFrame, list[str]]:
    """`cut_lineage` in files of about the same number of rows, in ranges of `order` and sorted by it: the table, its files. Tasks that meet every file read them
    from the shared folder, so rows are not copied for each of them."""
    rows = cut_lineage(df)  # the sort reads it twice
    table = cut_lineage(rows.repartitionByRange(count, *order).sortWithinPartitions(*order))
    release(rows)
    return table, sorted(table.inputFiles())


def read_file(uri: str, columns: list[str] | None = None) -> pa.Table:
    """Rows of a file of `cut_files`, in a task."""
    with _opened(uri) as file:
        return parquet.ParquetFile(file).read(columns=columns, use_threads=False)


def row_groups(table: DataFrame) -> list[tuple[str, int]]:
    """Files of a table of `cut_lineage` and their row groups, which have a bounded size."""
    out = []
    for uri in sorted(table.inputFiles()):
        with _opened(uri) as file:
            meta = parquet.ParquetFile(file).metadata
            out += [(uri, i) for i in range(meta.num_row_groups) if meta.row_group(i).num_rows]
    return out


def read_group(uri: str, group: int, rows: int, columns: list[str] | None = None) -> Iterator[pa.Table]:
    """A row group of a table in blocks of at most `rows`, in a task."""
    with _opened(uri) as file:
        for batch in parquet.ParquetFile(file).iter_batches(rows, row_groups=[group], columns=columns, use_threads=False):
            yield pa.Table.from_batches([batch])


def _opened(uri: str) -> pa.NativeFile:
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)
