"""Token-count rollups kept up to date by signed deltas.

A batch of changes (inserts, deletes, revised counts) becomes additive deltas of documents and tokens by source, language and tokenizer
version, and is committed once: its deltas are one Parquet folder named after the batch, whose `_SUCCESS` mark is the commit.
A batch that is committed already is left alone, a batch that failed half-way is written anew, so repeating any batch at any time changes
nothing. Totals are the sums over committed batches; `compact` folds them into one.

Changes hold (kind, source, lang, tokenizer, tokens, old_tokens); kind is insert, delete or revise. A null source or language is a
group of its own; null counts count as 0; other kinds are errors. Hot groups are summed before they are shuffled. Equal rows each count."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.tokens import token_ids

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    tokens, old = (F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("tokens", "old_tokens"))
    kind = F.col("kind")
    wrong = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))).cast("long")
    docs = F.when(kind == "insert", F.lit(1).cast("long")).when(kind == "delete", F.lit(-1).cast("long")).when(kind == "revise", F.lit(0).cast("long")).otherwise(wrong)
    signed = F.when(kind == "insert", tokens).when(kind == "delete", -tokens).when(kind == "revise", tokens - old).otherwise(wrong)
    return changes.groupBy(*KEYS).agg(F.sum(docs).alias("docs"), F.sum(signed).alias("tokens"))


class Rollup:
    """A store of committed batches below one shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _of(self, batch: str) -> str:
        """A folder name that any batch name maps to one to one."""
        return f"{self.folder}/batch-{hashlib.sha256(batch.encode()).hexdigest()[:32]}"

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(self._of(batch) + "/_SUCCESS"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """False if the batch was there already."""
        if self.committed(batch):
            return False
        deltas(changes).write.mode("overwrite").parquet(self._of(batch))
        return True

    def _folders(self) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = [f.getPath().toString() for f in self._fs.listStatus(self._path(self.folder)) if f.isDirectory()]
        return sorted(f for f in found if self._fs.exists(self._path(f + "/_SUCCESS")))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens); groups that came back to nothing are left out."""
        folders = self._folders()
        rows = self.spark.read.schema(DELTAS).parquet(*folders) if folders else self.spark.createDataFrame([], DELTAS)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")


def counted(docs: DataFrame, tokenizer: str, space_joins: bool, keep: tuple[str, ...]) -> DataFrame:
    """docs (text, kept columns) -> (kept columns, tokens)."""
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = token_ids(tokenizer, space_joins)
        for batch in batches:
            n = [len(b) // coder.dtype.itemsize for b in coder.encode([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(n, pa.int64())], names=[*kept, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return docs.select(*kept, "text").mapInArrow(run, f"{schema}, tokens long")


def new_folder(shared: str) -> str:
    return f"{shared}/{uuid.uuid4().hex}-rollup"
