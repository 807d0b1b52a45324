import zlib

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import language as L

WORDS = {"aa": "the and of to house window tree", "bb": "der die und haus fenster baum straße", "cc": "le la et maison fenêtre arbre été"}


def corpus(spark, n=300):
    import random

    r = random.Random(4)
    rows = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randrange(2, 40))), lang))
    rows += [(n, None, "aa"), (n + 1, "", "aa"), (n + 2, "12 - 3", "bb"), (None, "der die das haus", "cc"), (n + 3, "der baum und die straße", None), (n + 3, "der baum und die straße", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_texts_are_told_apart(spark):
    docs = corpus(spark)
    out = L.identified_languages(docs, L.fitted(docs), ("doc_id", "lang")).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 300 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 40 and sum(r["lang"] == r["lang_pred"] for r in held) > 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (300, 301, 302))
    assert by[303]["lang_pred"] == "bb" and by[None]["lang_pred"] == "bb"


def test_learns_only_from_its_part(spark):
    docs = corpus(spark, 120)
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang")))
    model = L.fitted(wrong)
    assert model.languages == ["aa", "bb", "cc"]


@pytest.mark.parametrize("rows", [[], [(1, "some text", None)], [(1, None, None)]])
def test_nothing_to_learn_from(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in L.identified_languages(docs, L.fitted(docs)).collect()] == [("und", 0.0)] * len(rows)


def test_every_language_is_a_class(spark):
    rows = [(i, " ".join([chr(97 + k // 8) * 2 + chr(97 + k % 8) * 3] * 20), f"l{k:02d}") for k in range(60) for i in range(k * 12, k * 12 + 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fitted(docs)
    assert len(model.languages) == 60
    out = L.identified_languages(docs, model, ("doc_id", "lang")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) > 0.9 * len(out)


def test_training_follows_a_plain_version():
    import math

    t = L.Training(epochs=1, held_back=3)
    bags = [("aa", [1, 2], [0.5, 0.5]), ("bb", [2, 3], [0.25, 0.75]), ("aa", [1], [1.0]), ("bb", [3], [1.0]), ("aa", [1, 3], [0.9, 0.1])]
    rows = [(x, L.np.array(b), L.np.array(s)) for x, b, s in bags]
    df = L.np.zeros(L.BUCKETS)
    df[[1, 2, 3]] = 3, 2, 3
    model = L.train(rows, t, df, 9)
    idf = {b: math.log(10 / (1 + df[b])) + 1 for b in (1, 2, 3)}
    own = [r for k, r in enumerate(bags) if k % 3 != 2]
    z, n = {}, {}

    def weight(f, c):
        a = z.get((f, c), 0.0)
        return 0.0 if abs(a) <= t.l1 else -(a - math.copysign(t.l1, a)) / ((t.smooth + math.sqrt(n.get((f, c), 0.0))) / t.rate + t.l2)

    for r in L.np.random.RandomState(5).permutation(len(own)):
        lang, b, s = own[r]
        x = {f: v * idf[f] * t.scale for f, v in zip(b, s)} | {"bias": 1.0}
        w = {(f, c): weight(f, c) for f in x for c in ("aa", "bb")}
        e = {c: math.exp(sum(w[f, c] * v for f, v in x.items())) for c in ("aa", "bb")}
        for c in e:
            miss = e[c] / sum(e.values()) - (c == lang)
            for f, v in x.items():
                g, old = v * miss, n.get((f, c), 0.0)
                z[f, c] = z.get((f, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / t.rate * w[f, c]
                n[f, c] = old + g * g
    for k, c in enumerate(("aa", "bb")):
        assert model.bias[k] == pytest.approx(weight("bias", c))
        assert all(model.weights[f, k] == pytest.approx(weight(f, c) * idf[f] * t.scale, rel=1e-5) for f in idf)
    losses = {x: -math.log(1 / (1 + math.exp(-sum((model.bias[0] - model.bias[1] + float(rows[2][2] @ (model.weights[rows[2][1], 0] - model.weights[rows[2][1], 1])),)) / x))) for x in (model.temperature, model.temperature * 1.3, model.temperature / 1.3)}
    assert losses[model.temperature] <= min(losses.values()) + 1e-6 or not math.exp(-1.0) * 1.31 < model.temperature < math.exp(3.0) / 1.31
