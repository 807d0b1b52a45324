import hashlib
import random

from tests.llm import brute
from tallyframe.llm import decontaminate as D
from tallyframe.llm.rows import identified
from pyspark.sql import functions as F

VOCABULARY = ["a", "b", "c", "dd", "É", "zz9", "q", "other", "x"]


def corpus(seed):
    r = random.Random(seed)
    say = lambda n: r.choice([" ", ". ", "-"]).join(r.choice(VOCABULARY) for _ in range(n))
    rows = [(i, say(r.choice([0, 1, 5, 40, 90]))) for i in range(50)] + [(50, None), (51, ""), (52, "..."), (53, "A b C " * 300)]
    items = [(i, say(r.choice([0, 1, 2, 3, 5]))) for i in range(10)] + [(10, None), (10, "a b c"), (None, "dd q"), (12, "a b c")]
    return rows, items


def found(spark, rows, items, width=3):
    docs = identified(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    out = D.found_phrases(docs, spark.createDataFrame(items, "item_id long, text string"), width=width)
    return {r["uid"]: (r["n_words"], sum(s["end_word"] - s["first_word"] for s in r["spans"]), len(r["items"]),
                       hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest()) for r in out.collect()}


def test_equals_brute_force(spark):
    rows, items = corpus(1)
    assert found(spark, rows, items) == brute.contamination(rows, items, 3)


def test_blocks_of_the_benchmark_are_merged(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 20)
    rows, items = corpus(2)
    assert found(spark, rows, items) == brute.contamination(rows, items, 3)


def test_empty_tables(spark):
    rows, items = corpus(3)
    assert found(spark, [], items) == {}
    assert all(v[1:3] == (0, 0) for v in found(spark, rows, []).values())


def test_spans_are_taken_out(spark):
    docs = identified(spark.createDataFrame([(1, "Un é mot. Secret words here, fin"), (2, "clean")], "doc_id long, text string"), "doc_id", "text")
    out = D.found_phrases(docs, spark.createDataFrame([(1, "secret WORDS here")], "item_id long, text string"), carry=("text",))
    assert [r[0] for r in out.orderBy("uid").select(D.without_spans("text", "spans").alias("t")).collect()] == ["Un é mot. , fin", "clean"]
    assert out.agg(F.sum(F.size("spans"))).first()[0] == 1
