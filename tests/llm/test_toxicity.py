"""Subword-bag classifier: gradients by differences, scores by a plain sum, held-out texts."""

import random
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import toxicity as T

SMALL = T.Training(rows=200, buckets=1 << 12)


def corpus(n=420, seed=6):
    r = random.Random(seed)
    clean = ["house", "tree", "window", "the", "and", "street", "morning", "paper", "green", "walk"]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(clean) for _ in range(r.randrange(20, 60))]
        toxic = int(r.random() < 0.4)
        if toxic:
            for _ in range(3):
                bad = r.choice(["blarghead", "snorkface"])
                k = r.randrange(1, len(bad))
                words[r.randrange(len(words))] = bad + "".join(r.choice("aeiouxz") for _ in range(3)) if r.random() < 0.7 else bad[:k] + bad[k] + bad[k:]
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic long")


def test_unseen_misspellings_in_held_out_texts(spark):
    rows, labels = corpus()
    docs, marks = frames(spark, rows, labels)
    out = {r["doc_id"]: r["score"] for r in T.scored(docs, T.fitted(docs, marks, SMALL)).collect()}
    held = [(out[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 100 and np.mean([(s >= 0.7) == bool(y) for s, y in held]) > 0.95


def test_learns_only_from_its_part(spark):
    rows, labels = corpus(150)
    docs, marks = frames(spark, rows, labels)
    other = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.fitted(docs, marks, SMALL), T.fitted(docs, other, SMALL)
    assert np.array_equal(a.table, b.table) and a.shift == b.shift


def test_scores_equal_the_softmax_of_the_mean(spark):
    rows, labels = corpus(150)
    rows += [(900, None), (901, ""), (902, "12 - 3"), (None, "tree tree blargheadxx"), (903, "Tree " * 30_000), (903, "Tree " * 30_000)]
    docs, marks = frames(spark, rows, labels)
    m = T.fitted(docs, marks, SMALL)
    got = T.scored(docs.withColumn("score", F.lit("x")), m, ("doc_id", "text", "score")).collect()
    assert len(got) == len(rows)
    for r in got:
        at, x = T.bag(r["text"], SMALL, {})
        z = (x * SMALL.scale) @ m.table[at] @ m.softmax + m.bias + np.array([0, m.shift])
        assert r["score"] == pytest.approx(float(np.exp(z[1]) / np.exp(z).sum()), abs=1e-4)


def test_first_step_follows_the_gradient():
    t = T.Training(buckets=64, dims=3, epochs=1, rate=1e-6, least_texts=1, scale=5.0)
    bags = [(np.array([1, 5, 9]), np.array([0.2, 0.5, 0.3]), 1)]
    start, end = T.train(bags, replace(t, rate=0.0)), T.train(bags, t)

    def loss(table, softmax, bias):
        z = (bags[0][1] * t.scale) @ table[bags[0][0]] @ softmax + bias
        return np.log(np.exp(z).sum()) - z[1]

    for name in ("table", "softmax", "bias"):
        values = {k: getattr(start, k).copy() for k in ("table", "softmax", "bias")}
        moved = getattr(end, name) - getattr(start, name)
        for at in np.argwhere(np.abs(moved) > 0)[:6]:
            up = values[name].copy()
            up[tuple(at)] += 1e-6
            slope = (loss(**{**values, name: up}) - loss(**values)) / 1e-6
            assert np.sign(slope) == -np.sign(moved[tuple(at)])


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(0, 1), (2, 1)], 1.0), ([(0, 0)], 0.0), ([(None, 1)], 0.0), ([(0, None)], 0.0)])
def test_nothing_to_tell_apart(spark, labels, score):
    docs, marks = frames(spark, [(0, "a tree"), (0, "a tree"), (2, None)], labels)
    assert [r["score"] for r in T.scored(docs, T.fitted(docs, marks)).collect()] == [score] * 3
    assert T.scored(docs.limit(0), T.fitted(docs, marks)).collect() == []
