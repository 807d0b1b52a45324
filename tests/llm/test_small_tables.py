"""URL filters, rollups, quotation links and the pipeline."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tallyframe.llm import quotes as T
from tallyframe.llm import rollups as R
from tallyframe.llm import urls as U
from tallyframe.session import checkpoint_dir
from tests.llm import brute

RULES = [("allow", "org/"), ("block", "x.org/es/"), ("block", "x.org/en/1"), ("block", "com/de/"), ("allow", "com/fr/")]


def test_urls(spark):
    urls = ["http://A.x.ORG/en/12?q", "https://x.org/es/", "https://x.org", "HTTP://notx.org/es/1#f", None, "no scheme", "", "http://h.com/de/5", "http://h.com/fr/5", "a://b://c/d", "ftp://com/de/"]
    urls += [f"http://h.com/{b}/{k}" for b in ("de", "fr", "en") for k in range(60)]
    urls += [f"http://bad.com/de/{k}" for k in range(60)] + [f"http://bad.com/en/{k}" for k in range(9)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://h.com/de/5"), (None, "http://h.com/de/5")]
    got = U.judged_urls(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got if r["page_id"] is not None}
    assert [(by[i]["host"], by[i]["path"], by[i]["rule"]) for i in range(11)] == [
        ("a.x.org", "/en/12", "x.org/en/1"), ("x.org", "/es/", "x.org/es/"), ("x.org", "", None), ("notx.org", "/es/1", "org/"), ("", "", None), ("", "", None), ("", "", None),
        ("h.com", "/de/5", "com/de/"), ("h.com", "/fr/5", "com/fr/"), ("b:", "//c/d", None), ("com", "/de/", "com/de/")]
    assert all(r["verdict"] == dict((p, k) for k, p in RULES)[r["rule"]] for r in got if r["rule"])
    assert {r["verdict"] for r in got if r["host"] == "bad.com"} == {"block"}
    assert by[11]["template"].startswith("/de/*") and by[11]["blocked_share"] > 0.5 > by[71]["blocked_share"]


def test_urls_of_an_empty_table(spark):
    assert U.judged_urls(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []


def test_rollup_equals_plain_sums_and_repeats_change_nothing(spark):
    schema = "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    batches = {"a/1": [("insert", "s", "en", "v1", 10, None), ("insert", "s", None, "v1", 5, None), ("insert", "s", "en", "v1", 10, None), ("insert", None, "en", "v2", None, None)],
               "a 2": [("revise", "s", "en", "v1", 12, 10), ("delete", "s", None, "v1", 5, None)], "empty": []}
    store = R.Rollup(spark, R.new_folder(checkpoint_dir(spark)))
    assert store.totals().collect() == []
    for name in ("a/1", "a 2", "a/1", "empty", "a 2"):
        store.commit(name, spark.createDataFrame(batches[name], schema))
    assert {tuple(r) for r in store.totals().collect()} == {("s", "en", "v1", 2, 22), (None, "en", "v2", 1, 0)}
    with pytest.raises(Exception, match="unknown kind"):
        store.commit("bad", spark.createDataFrame([("move", "s", "en", "v1", 1, None)], schema))
    assert not store.committed("bad") and store.totals().count() == 2


def test_quotes_are_linked(spark):
    rows = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "On Monday A wrote:\n> hello   THERE\n> How are you?\nFine."),
            (1, 2, "user", "> Fine.\n>> Hello there\n>> How are you?\nGood to hear"), (1, 3, "user", "> How are you?\nStill?"), (2, 0, "user", "> Fine.\nElsewhere"), (2, 1, "user", "> never said\nx"),
            (3, 0, "user", None), (None, 1, "user", "> a"), (3, None, None, ""), (4, 0, "u", "same"), (4, 0, "u", "same")]
    got = T.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[1, 1]["text"] == "Fine." and (by[1, 1]["n_quoted"], by[1, 1]["n_linked"], by[1, 1]["reply_turn"], by[1, 1]["depth"]) == (2, 2, 0, 1)
    assert (by[1, 2]["text"], by[1, 2]["reply_turn"], by[1, 2]["root_turn"], by[1, 2]["depth"], by[1, 2]["n_quoted"]) == ("Good to hear", 1, 0, 2, 3)
    assert (by[1, 3]["reply_turn"], by[1, 3]["depth"]) == (0, 1)
    assert (by[2, 0]["reply_turn"], by[2, 0]["source_conv"], by[2, 0]["source_turn"]) == (None, 1, 1)
    assert (by[2, 1]["n_quoted"], by[2, 1]["n_linked"]) == (1, 0) and by[3, 0]["text"] is None


def test_mail_gives_back_the_table(spark):
    rows = [(c, t, "user", f"text {c} {t}\nsecond line {t}") for c in range(5) for t in range(6)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = T.linked(T.as_mail(messages)).collect()
    assert {(r["conv_id"], r["turn"], r["text"]) for r in got} == {(c, t, x) for c, t, _, x in rows}
    assert all(r["reply_turn"] == (r["turn"] - 1 if r["turn"] else None) and r["depth"] == r["turn"] and r["root_turn"] == 0 for r in got)


def test_empty_conversations(spark):
    assert T.linked(T.as_mail(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


SF = "/root/testdata/sf0.001"


def test_pipeline_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = {r["doc_id"]: r["text"] for r in C.quality_rules(spark, docs, SF).collect()}
    kept = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in plain.items()], docs.schema)
    for _, stage in C.STAGES[1:4]:
        kept = stage(spark, kept, SF)
        assert kept.columns == C.COLUMNS
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        got = {r["doc_id"]: r["text"] for r in kept.collect()}
        rows = list(plain.items())
        if stage is C.ngram_jaccard_join:
            plain = {i: plain[i] for i, (_, c) in brute.jaccard(rows).items() if c == i}
        elif stage is C.suffix_array_dedup:
            removed = brute.repeats(rows)
            assert set(got) == {i for i in plain if removed[i][0] > removed[i][1] and got.get(i, "").strip()}
            assert all(hashlib.sha256(got[i].encode()).hexdigest() == removed[i][3] for i in got if b"\xef\xbf\xbd" not in got[i].encode() and len(got[i].encode()) == removed[i][0] - removed[i][1])
            plain = got
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            hit = brute.contamination(rows, items)
            assert all(got[i] == t for i, t in rows if not hit[i][1])
            assert all(v[0] == hit[i][0] - hit[i][1] for i, v in brute.contamination(list(got.items()), []).items())
            plain = got
        assert got == plain
    pieces = C.packing(spark, kept, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == set(plain)


def test_pipeline_of_an_empty_table(spark):
    docs = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in C.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == []
        docs = spark.createDataFrame([], docs.schema)
    assert F.col is not None


def test_a_character_cut_in_two_goes(spark):
    same = hashlib.sha512(b"x").hexdigest()[:120]  # with it goes the first byte that é and è share
    rows = [(1, "é" + same + "é", "en", "s", 0), (2, "ê" + same + "è words stay", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in C.suffix_array_dedup(spark, docs, SF).collect()}
    assert got[1] == rows[0][1] and got[2] == "ê words stay"
