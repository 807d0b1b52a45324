"""Name search by the bigram index against a scan, with ratios from the plain table of common subsequences."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators import name_index as I
from tallyframe.operators import search as S


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            left, row[j + 1] = row[j + 1], (left + 1 if x == y else max(row[j + 1], row[j]))
    return row[-1]


def ratio(a, b):
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain(needle, name):
    words = name.split()
    if needle == name:
        return 120.0
    if needle in words:
        return 115.0
    if any(w.startswith(needle) for w in words):
        return 110.0
    if needle in name:
        return 105.0 if name.startswith(needle) else 100.0
    x, y = set(needle.split()), set(words)
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    u, v = (" ".join([*sorted(x & y), *sorted(z)]) for z in (x - y, y - x))
    sets = [ratio(u, v)] + ([ratio(both, u), ratio(both, v)] if both else [])
    return max(ratio(needle, name), *sets, 0.95 * max(ratio(needle, w) for w in words))


FEW = ["ka", "lo", "mir", "ten", "sor", "bel", "du", "ris", "van", "jo", "ny", "ar"]
MANY = [c + v + e for c in "bcdfghjklmnprstvwz" for v in "aeiou" for e in ("", "n", "r", "s", "l")]


def made(n, seed, part=FEW):
    r = random.Random(seed)
    return [(i, " ".join("".join(r.choices(part, k=r.randint(1, 3))).capitalize() for _ in range(r.randint(1, 3))), f"s{i % 3}") for i in range(n)]


SCHEMA = "player_id long, player_name string, season string"
QUERIES = ["Kalo Mirten", "lo", "kalomirten sorbel", "x", "a", "Jony Arbel", "belsor  mirten", "zzzq", "mirten mirten van", "vna jo", "K", "soris-du"]


def test_index_finds_what_a_scan_of_all_names_finds(spark):
    rows = made(400, 3) + [(900, None, "s0"), (901, "--", "s0"), (902, "Kalo Mirten", "s1"), (903, "KALO mirten", "s1"), (904, "a" * 3000, "s2"), (903, "KALO mirten", "s1")]
    names = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = I.name_index(names, scope=("season",))
    for query in QUERIES:
        needle = S.searched_needle(query)
        for season in (None, "s1") if query in QUERIES[:3] else (None,):
            scored = [(-plain(needle, " ".join(n.replace("-", " ").lower().split())), n.lower(), i) for i, n, s in rows if n and n != "--" and season in (None, s)]
            want = [(i, round(-s, 9)) for s, _, i in sorted(scored) if -s >= 35][:8]
            part = index.within(season=season) if season else index
            got = [(r["player_id"], round(r["score"], 9)) for r in I.search_index(part, query).collect()]
            assert got == want, (query, season)
            if season is None and query in ("Kalo Mirten", "zzzq"):
                assert [(r["player_id"], round(r["score"], 9)) for r in S.search_players(names, query).collect()] == want


def test_bound_is_never_below_the_score(spark):
    texts = sorted({n.lower() for _, n, _ in made(600, 5)})
    index = I.name_index(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA))
    for needle in ("kalo mirten", "lo lo", "sorbel jony du", "mri tne"):
        bound = {r["searched"]: r["bound"] for r in I.bounded_names(index, needle).collect()}
        zero = {r["searched"]: r["b"] for r in index.names.select("searched", I.score_bound(F.col("searched"), F.lit(0), needle).alias("b")).collect()}
        assert all(bound.get(t, zero[t]) >= plain(needle, t) - 1e-9 for t in texts)


def test_scored_share_falls_as_the_table_grows(spark):
    misspelt, unlike = [], []
    for n in (1000, 16000):
        rows = made(n, 9, MANY)
        index = I.name_index(spark.createDataFrame(rows, SCHEMA))
        name = next(x for _, x, _ in rows if len(x) > 14).lower()
        total = index.names.select("searched").distinct().count()
        misspelt.append(I.survivors(index, name[:3] + name[4:-1], 8, 35.0).count() / total)
        unlike.append(I.survivors(index, "kalomir tensorr", 8, 35.0).count() / total)
    assert misspelt[1] < misspelt[0] < 0.5 and unlike[1] < unlike[0], (misspelt, unlike)


def test_empty_table_and_empty_search(spark):
    none = I.name_index(spark.createDataFrame([], T.StructType.fromDDL(SCHEMA)))
    assert I.search_index(none, "kalo").collect() == []
    some = I.name_index(spark.createDataFrame(made(5, 1), SCHEMA))
    assert I.search_index(some, " -- ").collect() == [] and I.search_index(some, "kalo", limit=0).collect() == []


def test_a_name_is_listed_once_whatever_scopes_it_comes_in(spark):
    rows = [(i, f"{n} x{i % 40}", f"s{i // 40}") for i, n, _ in [(i, f"kalo{i % 40}", None) for i in range(280)]]
    index = I.name_index(spark.createDataFrame(rows, SCHEMA), scope=("season",))
    listed = index.grams.groupBy("gram", "searched").count()
    assert listed.where("count > 1").isEmpty() and index.grams.select("searched").distinct().count() == 40
    only = I.name_index(spark.createDataFrame([*rows, (900, "sorbel", "s9")], SCHEMA), scope=("season",))
    assert [r["player_id"] for r in I.search_index(only.within(season="s9"), "sorbel").collect()] == [900]
    assert I.search_index(only.within(season="s1"), "sorbel").collect() == []
