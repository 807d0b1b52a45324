"""Importance resampling against a plain version."""

import random

import regex

from checks import compare as X
from tallyframe.llm import registered as Q
from tallyframe.llm import resample as S
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def corpus(n=160, seed=5):
    r = random.Random(seed)
    words = ["the", "Of", "ÉTÉ", "straße", "x1", "__", "-", "日本", "a.b", "it's", "\n", "\x00", "tree", "House"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(60)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "-- . "), (None, "the of " * 30), (n + 3, rows[0][1]), (n + 4, "long tree " * 60_000)]


def test_equals_a_plain_version(spark):
    rows, target = corpus(), ["the tree of x1", None, "House. HOUSE", ""]
    df = S.resampled(spark.createDataFrame(rows, SCHEMA).repartition(7), spark.createDataFrame([(t,) for t in target], "text string"))
    assert {r["doc_id"]: tuple(r)[1:] for r in df.collect()} == brute.resample(rows, target)


def test_longer_runs_and_other_parameters(spark):
    found, n = S.feature_buckets(b"A b-C d", S.word_runs(3), 1 << 20, S._spaced())
    import zlib

    assert n == 4 and sorted(found) == sorted(zlib.crc32(x) % (1 << 20) for x in (b"a", b"b", b"c", b"d", b"a b", b"b c", b"c d", b"a b c", b"b c d"))
    assert isinstance(S.word_runs(1), regex.Pattern) and len(S.feature_buckets(b"a b", S.word_runs(1), 10, S._spaced())[0]) == 2


def test_ties_empty_tables_and_clashing_names(spark):
    rows = [(1, "same words " * 20)] * 6
    docs = spark.createDataFrame([(*r, 9, 8) for r in rows], SCHEMA + ", rank long, n_words long")
    got = S.resampled(docs, spark.createDataFrame([], "text string"), percent=50, keep=("rank", "n_words", "doc_id")).collect()
    assert sorted((r["rank"] for r in got), key=lambda x: x or 9) == [1, 2, 3, None, None, None]
    assert S.resampled(docs.limit(0), docs.select("text")).collect() == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = Q.op13_importance_resampling(spark, sf)
    assert X.compare(df.columns, [tuple(r) for r in df.collect()], *X.run_sql(X.duck(sf), Q.O["op13_importance_resampling"])) == ""
