import hashlib
import random

import numpy as np
import pyarrow as pa

from tests.llm import brute
from tallyframe.llm import repeats as R
from tallyframe.llm.rows import identified


def corpus(seed, n=60):
    r = random.Random(seed)
    some = lambda k: "".join(r.choice("abcdé \n") for _ in range(k))
    passages = [some(r.choice([99, 100, 101, 180, 400])) for _ in range(6)]
    rows = []
    for i in range(n):
        t = some(r.randrange(0, 300))
        for _ in range(r.randrange(0, 4)):
            t += r.choice(passages) + some(r.randrange(0, 150))
        if rows and r.random() < 0.2:
            old = r.choice(rows)[1]
            k = r.randrange(0, len(old) + 1)
            t = old if r.random() < 0.4 else old[:k] + "X" + old[k:]
        rows.append((i * 7 % 61, t))
    return [*rows, (900, None), (901, ""), (902, "z" * 500), (903, "ab" * 200), (904, "z" * 100), (905, "z" * 99), (906, "z" * 350)]


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = {}
    for r in R.without_repeats(identified(docs, "doc_id", "text")).collect():
        removed = sum(s["end"] - s["start"] for s in r["removed"])
        kept = bytes(r["kept"])
        assert r["uid"] not in out
        out[r["uid"]] = (removed + len(kept), removed, len(r["removed"]), hashlib.sha256(kept).hexdigest())
    return out


def test_equals_brute_force(spark):
    rows = corpus(1)
    assert found(spark, rows) == brute.repeats(rows)


def test_grams_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "RUNS_IN_A_TASK", 3)
    rows = corpus(2)
    assert found(spark, rows) == brute.repeats(rows)


def test_empty_table(spark):
    assert found(spark, []) == {}


def test_a_gram_of_many_runs_spreads_by_its_windows():
    r = random.Random(4)
    some = lambda k: "".join(r.choice("abcdefgh \n") for _ in range(k))
    line = some(85)
    texts = [some(60) + line + some(60) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["uid", "text"])
    asked = {}
    for b in R._by_text(R._shared(R._anchors(64)([batch]), 64, 20)):
        asked.update(zip(b.column("uid").to_pylist(), b.column("runs").to_pylist()))
    of = sorted(u for u in asked if asked[u])
    hot = pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array([texts[u] for u in of]), pa.array([asked[u] for u in of], pa.binary())], names=["uid", "text", "runs"])
    fetched = list(R._fetched(64)([hot]))
    sizes = {}
    for b in fetched:
        for bucket, runs, windows in zip(*(b.column(c).to_pylist() for c in ("bucket", "runs", "windows"))):
            sizes[bucket] = sizes.get(bucket, 0) + len(runs or b"") + len(windows or b"")
    windows = sum(int(np.frombuffer(asked[u], R._REQUEST)["more"].sum()) + len(asked[u]) // R._REQUEST.itemsize for u in of)
    assert windows > 2000 and len(sizes) == 64
    assert sum(sizes.values()) < 21 * windows and max(sizes.values()) < 3 * sum(sizes.values()) / 64
    assert all(len(b.column("uid")) == 0 for b in R._sorted_windows(fetched))


def test_repeats_of_a_gram_of_many_runs(spark, monkeypatch):
    monkeypatch.setattr(R, "RUNS_IN_A_TASK", 20)
    r = random.Random(6)
    some = lambda k: "".join(r.choice("abcdefgh \n") for _ in range(k))
    line, pieces = some(85), [some(60) for _ in range(8)]
    rows = [(i, r.choice([some(70), r.choice(pieces)]) + line + r.choice([some(70), r.choice(pieces)]) + some(i % 50)) for i in range(300)]
    assert found(spark, rows) == brute.repeats(rows)
