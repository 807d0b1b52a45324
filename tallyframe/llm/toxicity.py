"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word (a run of letters, lower-cased) is the bag of itself and its character n-grams with marked ends, each hashed to a row of an embedding
table. A text is the mean of the rows of its subwords (repeats of a word damped, with some neutral subwords added), and a linear softmax over that mean gives the chances of both classes. Table and softmax are
trained together in numpy, one text at a time, with steps by AdaGrad. A misspelled or inflected word that was never seen still shares most n-grams with
words that were, and so their vectors.

Learning takes at most `rows` labelled texts of each class, those with the smallest hash of their id, of at most `longest` characters each (documented
bounds of a classifier's sample); the classes' true shares over all allowed labels are put back into the scores. Every whole text is scored.

Null or empty texts and texts without letters have an empty bag: they get the chance of the bias alone. With no labels, or labels of one class, there is
nothing to tell apart: every score is the share of label 1 (0 without labels). Rows without an id are scored and never learned from; equal rows are scored alike;
other columns are ignored unless asked for, and an asked-for column
named score gives way to the result. An empty table gives no rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.rows import columns_ddl, small_batches

_WORD = re.compile(r"[^\W\d_]+")
#: Words whose sums a worker remembers before it starts anew.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Training:
    rows: int = 2000
    longest: int = 20_000
    buckets: int = 1 << 17
    dims: int = 8
    least_texts: int = 3  # subwords of fewer learned texts keep no vector
    shortest_gram: int = 3
    longest_gram: int = 5
    epochs: int = 12
    rate: float = 0.3
    scale: float = 300.0  # shares of a bag are small numbers
    neutral: float = 300.0  # subwords without a vector in every bag, so that one strange word does not decide a short text
    slow: float = 1.0  # where a row's sum of squared steps starts: rows that few texts share move little


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def subwords(word: str, t: Training) -> list[int]:
    """Buckets of a word and its character n-grams."""
    marked = f"<{word}>"
    parts = [marked] + [marked[i : i + n] for n in range(t.shortest_gram, t.longest_gram + 1) for i in range(len(marked) - n + 1) if n < len(marked)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % t.buckets for p in parts]


def bag(text: str | None, t: Training, known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, their shares of all subwords) of a text; a word that comes n times counts 1 + ln n times. `known` remembers words."""
    words = Counter(_WORD.findall((text or "").lower()))
    for w in words:
        if w not in known:
            known[w] = subwords(w, t)
    buckets = np.array([b for w in words for b in known[w]], np.int64)
    counts = np.repeat([1 + math.log(n) for n in words.values()], [len(known[w]) for w in words])
    distinct, at = np.unique(buckets, return_inverse=True)
    shares = np.bincount(at, counts, len(distinct))
    return distinct, shares / (t.neutral + shares.sum())


@dataclass
class Model:
    training: Training
    table: np.ndarray  # bucket x dims
    softmax: np.ndarray  # dims x 2
    bias: np.ndarray  # 2
    shift: float = 0.0  # of the log odds, from the sample's shares to the true ones

    def gains(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log odds of label 1 when it is the whole bag, and the log odds of an empty bag."""
        way = self.softmax[:, 1] - self.softmax[:, 0]
        return self.training.scale * (self.table @ way), float(self.bias[1] - self.bias[0]) + self.shift


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], t: Training) -> Model:
    """bags of (buckets, shares, label) in a fixed order."""
    turn = np.random.RandomState(11)
    texts = np.bincount(np.concatenate([np.empty(0, np.int64), *(b for b, *_ in bags)]), minlength=t.buckets)
    bags = [(b[texts[b] >= t.least_texts], x[texts[b] >= t.least_texts], label) for b, x, label in bags]
    table = turn.uniform(-0.5 / t.dims, 0.5 / t.dims, (t.buckets, t.dims))
    table[texts < t.least_texts] = 0
    softmax, bias = turn.uniform(-0.5, 0.5, (t.dims, 2)), np.zeros(2)
    n_table, n_softmax, n_bias = np.full(t.buckets, t.slow), np.full((t.dims, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(t.epochs):
        for r in turn.permutation(len(bags)):
            at, x, label = bags[r]
            x = x * t.scale
            mean = x @ table[at]
            z = mean @ softmax + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = softmax @ p
            g = np.outer(mean, p)
            n_softmax += g * g
            softmax -= t.rate * g / np.sqrt(n_softmax)
            n_bias += p * p
            bias -= t.rate * p / np.sqrt(n_bias)
            n_table[at] += x * x * (back @ back)
            table[at] -= (t.rate * x / np.sqrt(n_table[at]))[:, None] * back
    return Model(t, table, softmax, bias)


def fitted(docs: DataFrame, labels: DataFrame, training: Training | None = None) -> Model | float:
    """From docs (doc_id, text) and labels (doc_id, toxic), of rows whose remainder is not 1. A number if there is nothing to tell apart."""
    t = training or Training()
    own = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 1))
    seen = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return float(next(iter(seen), 0))
    turn = F.xxhash64("doc_id")
    chosen = []
    for label, n in seen.items():
        few = own.filter((F.col("toxic") == label) & (F.pmod(turn, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.5 * t.rows / n))))  # some more than asked for, whatever the table's size
        chosen.append(few.orderBy(F.pmod(turn, F.lit(1 << 30)), turn).limit(t.rows))
    ids = chosen[0].unionByName(chosen[1]).distinct()
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= t.longest)).join(F.broadcast(ids), "doc_id")
    texts = texts.orderBy(turn, "doc_id", "toxic", "text").limit(2 * t.rows).select("toxic", "text").collect()
    known: dict[str, list[int]] = {}
    made = [(*bag(r["text"], t, known), r["toxic"]) for r in texts]
    taken = np.bincount([label for *_, label in made], minlength=2)
    if not taken.all():
        return seen[1] / (seen[0] + seen[1])
    model = train(made, t)
    model.shift = float(np.log(seen[1] / seen[0]) - np.log(taken[1] / taken[0]))
    return model


def scored(docs: DataFrame, model: Model | float, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (text, kept columns) -> (kept columns, score)."""
    kept = [c for c in dict.fromkeys(keep) if c not in ("score", "_text")]
    if not isinstance(model, Model):
        return docs.select(*kept, F.lit(model).alias("score"))
    small_batches(docs.sparkSession)
    gains, rest = model.gains()
    known = docs.sparkSession.sparkContext.broadcast((model.training, gains.astype(np.float32), rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, gains, rest = known.value
        sums: dict[str, tuple[float, int]] = {}
        for batch in batches:
            scores = []
            for text in batch.column("_text").to_pylist():
                total, n = 0.0, t.neutral
                for w, times in Counter(_WORD.findall(text.lower()) if text else ()).items():
                    got = sums.get(w)
                    if got is None:
                        at = subwords(w, t)
                        if len(sums) >= REMEMBERED:
                            sums.clear()
                        got = sums[w] = (float(gains[at].sum(dtype=np.float64)), len(at))
                    damped = 1 + math.log(times)
                    total += damped * got[0]
                    n += damped * got[1]
                scores.append(float(1 / (1 + np.exp(-np.clip(rest + total / n, -500, 500)))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(scores, pa.float64())], names=[*kept, "score"])

    return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(run, columns_ddl(docs, kept, "score double"))
