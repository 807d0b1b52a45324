import random

from tests.llm import brute
from tallyframe.llm import jaccard as J
from tallyframe.llm.rows import identified


def corpus(seed, n=160):
    """Families of near copies, exact copies, shared passages, short and empty texts."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(400)
    passage = [word() for _ in range(40)]
    rows, bases = [], [[word() for _ in range(r.choice([6, 9, 20, 60, 200]))] for _ in range(12)]
    for i in range(n):
        kind = r.random()
        if kind < 0.5:
            w = list(r.choice(bases))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = word()
        elif kind < 0.7:
            w = [word() for _ in range(r.randrange(3, 30))] + passage
        elif kind < 0.8:
            w = [r.choice("ab") for _ in range(r.randrange(0, 8))]
        else:
            w = [word() for _ in range(r.randrange(1, 50))]
        rows.append((i * 3, " ".join(w).upper() if r.random() < 0.1 else r.choice([" ", "\n", "  "]).join(w)))
    return [*rows, (10_000, None), (10_001, ""), (10_002, " \t\n"), (10_003, "one"), (10_004, "One"), (10_005, "x\x00y é"), (10_006, "X\x00Y é")]


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return {r["uid"]: (r["n_shingles"], r["component"]) for r in J.jaccard_components(identified(docs, "doc_id", "text")).collect()}


def test_equals_brute_force(spark):
    rows = corpus(1)
    assert found(spark, rows) == brute.jaccard(rows)


def test_common_shingles_and_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "COMMON_LEAST", 4)
    monkeypatch.setattr(J, "BLOCK", 3)
    rows = corpus(2, 120)
    assert found(spark, rows) == brute.jaccard(rows)


def test_empty_table(spark):
    assert found(spark, []) == {}


def test_trees_lose_no_pair():
    import numpy as np

    r = np.random.RandomState(3)
    sets = [np.unique(r.randint(0, 2**62, n).astype(np.uint64)) for n in r.randint(1, 300, 150)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.9)], r.randint(0, 2**62, 2).astype(np.uint64)])) for s in sets]
    tree = J.CountTree([J.point(s) for s in sets], np.array([len(s) for s in sets]))
    pairs = {tuple(sorted(p)) for p in tree.join(np.arange(len(sets))).tolist()}
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
              if 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (len(sets[i]) + len(sets[j]))}
    assert linked and linked <= pairs and len(pairs) < len(sets) ** 2 / 8


def listed(*sets):
    """What `_lists` gives for sets (digest, size) that share one shingle."""
    import numpy as np
    import pyarrow as pa

    rows = {"digest": [d for d, _ in sets], "n": [n for _, n in sets], "prefix": [np.array([77], np.uint64).tobytes()] * len(sets)}
    out = [b.to_pylist() for b in J._lists(J._dealt(8)(iter([pa.RecordBatch.from_pydict(rows)])))]
    return sorted((r["a"], r["b"], r["star"]) for rows in out for r in rows)


def test_only_runs_of_three_sizes_or_more_are_groups():
    assert listed((1, 40), (2, 50)) == [(1, 2, True)]
    assert listed((1, 40), (2, 400)) == []
    assert listed((1, 40), (2, 400), (3, 500), (4, 600)) == [(2, 2, False), (2, 3, False), (2, 3, True), (2, 4, False)]


def test_trees_mark_groups_where_pairs_are_left_aside():
    import numpy as np
    import pyarrow as pa

    vector = J.point(np.arange(1, 41).astype(np.uint64)).tobytes()

    def trees(label, one_each):
        rows = {"pivot": [9] * 3, "block": [0] * 3, "digest": [11, 12, 13], "n": [40] * 3, "label": label, "vector": [vector] * 3}
        return {tuple(r.values()) for b in J._trees(iter([pa.RecordBatch.from_pydict(rows)]), one_each) for r in b.to_pylist()}

    assert trees([1, 2, 3], True) == {(11, 12), (11, 13), (12, 13)}
    some = trees([1, 1, 2], True)
    assert (9, None) in some and len(some) == 2
    assert trees([1, 1, 2], False) == {(11, 13), (12, 13)}
