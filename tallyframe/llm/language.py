"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character one- to four-grams of the lower-cased text (every run of other characters than letters is one space), hashed into
buckets; a weight is the n-gram's share of the text times its inverse document frequency. The model is trained by
follow-the-regularised-leader with elastic-net penalties, one text at a time, and its scores are divided by a temperature that is fitted
on texts kept back from training.

Every language of the allowed rows is a class (a column of weights each). Document frequencies are counted over all allowed rows; training takes at most
`per_language` texts of each language and about `rows` in all, those with the smallest hash of their id (documented bounds of a classifier's sample); whole texts are
used, and every text is predicted. Texts that are null or
have no letter get "und" and score 0, and so do all texts if there is nothing to learn from. Rows without an id are predicted and never
learned from. Equal rows are predicted alike."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.rows import small_batches

BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
UNKNOWN = "und"


@dataclass(frozen=True)
class Training:
    per_language: int = 500
    rows: int = 25_000
    epochs: int = 4
    rate: float = 0.5
    smooth: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    scale: float = 8.0  # shares of a text are small numbers
    held_back: int = 5  # every so many-th text is for the temperature


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


_CLASS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; the others become spaces."""
    if not _CLASS:
        _CLASS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _CLASS[0]


def gram_buckets(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text, in order, repeats included."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, 32)
    keep = np.ones(len(code), bool)
    keep[1:] = letter[1:] | letter[:-1]
    code = np.concatenate([[32], code[keep], [32]]).astype(np.uint32)
    out, rolled = [], np.zeros(len(code), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        rolled = rolled[: len(code) - n + 1] * np.uint32(0x9E3779B1) + code[n - 1 :] + np.uint32(n)
        if n in GRAMS:
            x = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append(x >> np.uint32(16))
    return np.concatenate(out)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buckets, shares = [], []
        for t in batch.column("text").to_pylist():
            b, n = np.unique(gram_buckets(t), return_counts=True)
            buckets.append(b.astype("<u4").tobytes())
            shares.append((n / n.sum()).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("turn"), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())],
                                         names=["lang", "turn", "buckets", "shares"])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language, times the inverse document frequency
    bias: np.ndarray
    temperature: float

    def chances(self, grams: np.ndarray) -> np.ndarray:
        z = (self.bias + self.weights[grams].mean(0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's texts hold each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            total[np.unique(gram_buckets(text))] += 1
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], t: Training, df: np.ndarray, texts: int) -> Model | None:
    """rows of (language, buckets, shares) in a fixed order; `df` of the `texts` allowed texts hold a bucket."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    number = {x: k for k, x in enumerate(languages)}
    idf = np.log((1 + texts) / (1 + df)) + 1
    back = [r for k, r in enumerate(rows) if k % t.held_back == t.held_back - 1]
    own = [r for k, r in enumerate(rows) if k % t.held_back != t.held_back - 1]
    k = len(languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))  # the last row is the bias

    def weight(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        w = -(zs - np.sign(zs) * t.l1) / ((t.smooth + np.sqrt(ns)) / t.rate + t.l2)
        return np.where(np.abs(zs) <= t.l1, 0.0, w)

    turn = np.random.RandomState(5)
    for _ in range(t.epochs):
        for r in turn.permutation(len(own)):
            lang, b, s = own[r]
            at, x = np.append(b, BUCKETS), np.append(s * idf[b] * t.scale, 1.0)
            w = weight(at)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[number[lang]] -= 1
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / t.rate
            z[at] += g - step * w
            n[at] += g * g
    w = weight(np.arange(BUCKETS + 1))
    model = Model(languages, (w[:BUCKETS] * idf[:, None] * t.scale).astype(np.float32), w[BUCKETS], 1.0)
    scores = np.array([model.bias + s @ model.weights[b] for _, b, s in back]).reshape(-1, k)
    truth = np.array([number[r[0]] for r in back], np.int64)

    def loss(log_t: float) -> float:
        y = scores / np.exp(log_t)
        y = y - y.max(1, keepdims=True)
        return float((np.log(np.exp(y).sum(1)) - y[np.arange(len(y)), truth]).mean())

    if len(back):
        low, high = -1.0, 3.0
        for _ in range(60):  # golden section
            a, b = low + 0.382 * (high - low), low + 0.618 * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


def fitted(docs: DataFrame, training: Training | None = None) -> Model | None:
    """From docs (doc_id, text, lang), of rows whose remainder is not 2."""
    t = training or Training()
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & (remainder(F.col("doc_id")) != 2) & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as languages
    each = max(1, min(t.per_language, t.rows // max(1, len(sizes))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    known = F.broadcast(docs.sparkSession.createDataFrame([(x, int((1 << 30) * min(1.0, (1.5 * each + 20) / n))) for x, n in sizes.items()], "lang string, bound long"))
    turn = Window.partitionBy("lang").orderBy(place, "doc_id")
    few = rows.select("doc_id", "lang").join(known, "lang").where(place < F.col("bound"))  # some more than asked for, whatever the table's size
    chosen = few.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= each)
    sample = rows.join(F.broadcast(chosen.select("doc_id", "turn").distinct()), "doc_id").select("lang", "turn", "text")
    made = sample.mapInArrow(_featured, "lang string, turn int, buckets binary, shares binary").collect()  # about t.rows texts
    made = sorted(((r["turn"], r["lang"], bytes(r["buckets"]), bytes(r["shares"])) for r in made))
    df = np.zeros(BUCKETS)
    for r in rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        df[r["bucket"]] = r["n"]
    return train([(lang, np.frombuffer(b, "<u4").astype(np.int64), np.frombuffer(s, "<f4").astype(float)) for _, lang, b, s in made], t, df, sum(sizes.values()))


def identified_languages(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (text, kept columns) -> (kept columns, lang_pred, score)."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            langs, scores = [], []
            for t, letters in zip(batch.column("text").to_pylist(), batch.column("_letters").to_pylist()):
                if m is None or not letters:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = m.chances(gram_buckets(t))
                best = int(p.argmax())
                langs.append(m.languages[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    rows = docs.select(*kept, "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
