"""URL filters by a tree of path templates, in DataFrame functions only.

Per host, a path's segments form a tree. Going down level by level, a node whose children are many and mostly different is generalised to
one wildcard child `*`; literal children whose share of blocked pages does not differ from their node's (a z-test) are
merged into one child `~`; others keep their name. Labelled pages are counted at every template, and a template's share of blocked
pages is smoothed towards its parent's, up to the host and the whole table; above `reject` it is blocked. Rules given by
hand decide first and can serve as the labels.

The tree grows while a node holds two distinct paths and one of them goes on, so it is as deep as paths share templates; each level is a grouped pass over
the paths still open. A path that ends in such a node is its child with an empty name, as is one that ends in a slash there.

Pages without a url, or whose url has no `://`, have an empty host and path and are judged like others. Equal rows are judged alike; extra
columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

WILD = {"children": 8, "distinct_share": 0.2}
Z = 1.96
WEIGHT = 10.0
REJECT = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host/path) that fits, else nulls. A short list of rules written by hand."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^/", ""), "/")


def template_tree(paths: DataFrame) -> DataFrame:
    """paths (host, segments; n pages, nl labelled, nb of them blocked) -> (host, segments, template, q), q the smoothed share of blocked pages."""
    counts = ("n", "nl", "nb")
    top = paths.agg(((F.coalesce(F.sum("nb"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("nl"), F.lit(0)) + 2.0)).alias("q"))
    rows = paths.crossJoin(F.broadcast(top)).withColumn("template", F.array().cast("array<string>"))  # one row
    done, k = None, 0
    while True:
        here = rows.groupBy("host", "template").agg(F.sum("nl").alias("l"), F.sum("nb").alias("b"), F.count(F.lit(1)).alias("paths"), F.max(F.size("segments")).alias("deep"))
        q = (F.col("b") + WEIGHT * F.col("q")) / (F.col("l") + WEIGHT)
        grows = (F.col("paths") > 1) & (F.col("deep") > k)
        rows = cut_lineage(rows.join(here, ["host", "template"]).select("host", "segments", *counts, "template", q.alias("q"), grows.alias("grows")))
        ended = rows.where(~F.col("grows")).select("host", "segments", "template", "q")
        done = ended if done is None else done.unionByName(ended)
        rows = rows.where("grows").drop("grows").withColumn("s", F.coalesce(F.get("segments", F.lit(k)), F.lit("")))
        if rows.isEmpty():
            return done
        node = ["host", "template"]
        child = rows.groupBy(*node, "s").agg(*[F.sum(c).alias(c) for c in counts])
        whole = child.groupBy(*node).agg(F.count(F.lit(1)).alias("children"), *[F.sum(c).alias(f"p_{c}") for c in counts])
        share = (F.col("p_nb") + 1.0) / (F.col("p_nl") + 2.0)
        own = (F.col("nb") + share) / (F.col("nl") + 1.0)
        alike = F.abs(own - share) <= Z * F.sqrt(share * (1.0 - share) / (F.col("nl") + 1.0))
        many = (F.col("children") >= WILD["children"]) & (F.col("children") >= WILD["distinct_share"] * F.col("p_n"))
        kind = F.when(F.col("s") == "", F.lit("")).when(many, F.lit("*")).when(alike, F.lit("~")).otherwise(F.col("s"))
        kinds = child.join(whole, node).select(*node, "s", kind.alias("t"))
        rows = rows.join(kinds, [*node, "s"]).withColumn("template", F.concat("template", F.array("t"))).drop("s", "t")
        k += 1


def judged_urls(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """pages (page_id, url) -> (page_id, host, path, rule, verdict, template, blocked_share). The rules' verdicts are the labels."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, by_rule = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), by_rule.alias("by_rule"), segments(F.col("path")).alias("segments"))
    labelled = F.col("by_rule").isNotNull().cast("long")
    blocked = F.col("by_rule").eqNullSafe("block").cast("long")
    paths = cut_lineage(rows.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), F.sum(labelled).alias("nl"), F.sum(blocked).alias("nb")))
    found = template_tree(paths).select("host", "segments", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), F.col("q").alias("blocked_share"))
    verdict = F.coalesce("by_rule", F.when(F.col("blocked_share") > REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(found, ["host", "segments"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "blocked_share")
