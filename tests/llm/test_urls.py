"""The template tree against SQL and a plain recursive version on paths of any depth."""

import random

import duckdb

from tallyframe.llm import sql
from tallyframe.llm import urls as U
from tallyframe.llm.registered import URL_RULES


def plain(rows):
    """blocked share by (host, path) of rows (host, path, label or None)."""
    pages = {}
    for host, path, label in rows:
        c = pages.setdefault((host, tuple(path.removeprefix("/").split("/"))), [0, 0, 0])
        for i, x in enumerate((1, label is not None, label == "block")):
            c[i] += x
    add = lambda keys: [sum(pages[k][i] for k in keys) for i in range(3)]
    _, nl, nb = add(pages)
    out = {}

    def grow(keys, k, q):
        n, nl, nb = add(keys)
        q = (nb + 10.0 * q) / (nl + 10.0)
        if len(keys) < 2 or max(len(s) for _, s in keys) <= k:
            out.update(dict.fromkeys(keys, q))
            return
        children, merged = {}, {}
        for key in keys:
            children.setdefault(key[1][k] if len(key[1]) > k else "", []).append(key)
        share = (nb + 1.0) / (nl + 2.0)
        for s, below in children.items():
            _, cl, cb = add(below)
            alike = abs((cb + share) / (cl + 1.0) - share) <= 1.96 * (share * (1.0 - share) / (cl + 1.0)) ** 0.5
            t = s and ("*" if len(children) >= 8 and len(children) >= 0.2 * n else "~" if alike else s)
            merged.setdefault(t, []).extend(below)
        for below in merged.values():
            grow(below, k + 1, q)

    for host in {h for h, _ in pages}:
        grow([k for k in pages if k[0] == host], 0, (nb + 1.0) / (nl + 2.0))
    return out


def deep_pages():
    r = random.Random(4)
    urls = [f"http://h{h}.com/{r.choice(['de', 'fr', 'en'])}/" + "/".join(r.choice(["a", "b", "bad", str(r.randint(0, 99)), ""]) for _ in range(r.randint(0, 6))) for h in range(4) for _ in range(150)]
    urls += [f"http://www.example.org/en/{r.randint(1, 30)}/{x}" for x in ("a", "b", "") for _ in range(30)] + ["http://net.net", None, "x", "http://net.net/", "http://net.net//a"]
    return list(enumerate(urls + urls[:40]))


def test_tree_of_any_depth_equals_sql_and_a_plain_version(spark):
    pages = deep_pages()
    got = U.judged_urls(spark.createDataFrame(pages, "page_id long, url string").repartition(4), URL_RULES).collect()
    verdicts = {v: k for k, v in URL_RULES}
    want = plain([(r["host"], r["path"], verdicts.get(r["rule"])) for r in got])
    assert len(got) == len(pages)
    for r in got:
        assert abs(r["blocked_share"] - want[r["host"], tuple(r["path"].removeprefix("/").split("/"))]) < 1e-9, r
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    cols = ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(tuple(r[c] for c in cols) for r in got) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({sql.OP3})").fetchall())
    assert max(r["template"].count("/") for r in got) > 4


def test_a_bad_branch_far_down_is_judged_by_itself(spark):
    rules = [("block", f"h.com/a/b/bad/{k}") for k in range(1, 8)] + [("allow", f"h.com/a/b/good/{k}") for k in range(1, 8)]
    urls = [f"http://h.com/a/b/{x}/{k}{y}" for x in ("bad", "good") for k in range(1, 8) for y in range(10)] + ["http://h.com/a/b/bad/9", "http://h.com/a/b/good/9"]
    got = {r["path"]: r for r in U.judged_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert (got["/a/b/bad/9"]["rule"], got["/a/b/bad/9"]["verdict"], got["/a/b/good/9"]["verdict"]) == (None, "block", "allow")


def test_one_very_long_path(spark):
    urls = ["http://h.com/" + "x/" * 20_000, "http://h.com/y", "http://h.com/" + "z" * 100_000]
    got = U.judged_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES).collect()
    assert sorted(r["page_id"] for r in got) == [0, 1, 2]
