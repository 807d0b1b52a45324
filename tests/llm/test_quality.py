import random
import re

import corpus_pipeline
from tallyframe.llm import quality as Q


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen: dict = {}
    for k in range(len(w) - 7):
        seen.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {i for places in seen.values() if len(places) > 1 for k in places for i in range(k, k + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_base_columns_equal_plain_python(spark):
    r = random.Random(2)
    words = ["alpha", "béta", "Γ", "d#e", "<x>", "12", "𝒳y"]
    texts = [None, "", " \t ", "\n\n", "one", "a\x00b", "x " * 500]
    for _ in range(120):
        line = lambda: " ".join(r.choice(words) for _ in range(r.randrange(0, 12)))
        lines = [line() for _ in range(r.randrange(1, 9))]
        texts.append(r.choice(["\n", "\r\n", " \n"]).join(r.choice(lines) for _ in range(r.randrange(1, 20))))
    docs = spark.createDataFrame([(i, t, r.choice(["en", None])) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in Q.judged(docs).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == plain(t), (i, t)
        assert not (x["base_failed"] and x["kept"])


def test_junk_goes_and_clean_texts_stay(spark):
    r = random.Random(3)
    words = [chr(97 + i % 26) * 2 + chr(97 + i % 7) for i in range(60)]
    rows = [(i, " ".join(r.choice(words).capitalize() if r.random() < 0.1 else r.choice(words) for _ in range(120)), "en") for i in range(80)]
    rows += [(100, " ".join(r.choice(words).upper() + "!!" for _ in range(120)), "en"), (101, " ".join(r.choice(words) + "%%%" for _ in range(120)), "en"), (102, rows[0][1], "xx")]
    got = {x["doc_id"]: x["kept"] for x in Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(80)) and got[102] and not got[100] and not got[101]


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert Q.judged(docs).collect() == []
    docs = spark.createDataFrame([(1, "a b", "en", 5), (1, "a b", "en", 5)], "doc_id long, text string, lang string, n_plain int")
    assert [x["kept"] for x in Q.judged(docs).collect()] == [False, False]


def test_the_query_and_the_pipeline_reject_texts_of_another_language_and_without_common_words(spark):
    r = random.Random(5)

    def text(lang, n, common=0.3):
        return " ".join(lang * 2 + chr(97 + min(23, int(r.expovariate(0.2)))) if r.random() < common else lang + "".join(r.choice("aeinrst") for _ in range(7)) for _ in range(n))

    lengths = [60, 120, 300, 900]
    rows = [(k * 100 + i, text(x, lengths[i % 4]), x) for k, x in enumerate("pq") for i in range(80)]
    other = [(1000 + i, text("q", n), "p") for i, n in enumerate(lengths)]
    bare = [(2000 + i, text("p", n, 0), "p") for i, n in enumerate(lengths)]
    few = [(3000, text("q", 300), "rare"), (3001, text("q", 300), None)]
    docs = spark.createDataFrame([(*x, "s", len(x[1])) for x in rows + other + bare + few], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x["doc_id"] for x in corpus_pipeline.quality_rules(spark, docs, "").collect()} == {x[0] for x in rows + few}
    assert {x["doc_id"] for x in Q.judged(docs).filter("kept").collect()} == {x[0] for x in rows + few}


def test_the_pool_counts_every_word_of_every_language(spark):
    rows = [(k, ("w" + x + " ") * 3 + "shared", x) for k, x in enumerate("abcdefgh")]
    whole = Q.references(spark.createDataFrame(rows, "doc_id long, text string, lang string"), common=1).filter("lang is null").first()
    assert (whole["ref_words"], whole["ref_counts"]) == (["shared"], [8.0, 24.0])
