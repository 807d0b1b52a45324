"""Name search by an inverted index of bigrams.

Each distinct name is listed once, whatever scopes (seasons, say) it comes in, under the bigrams of its words, every word between two spaces, with the number of times it holds
them; a search within a scope keeps the names that scope holds. A search
reads the lists of its own bigrams only. The m bigrams two texts share bound their common subsequence: of the a - 1 bigrams of a text of length a
a deleted letter breaks at most two and an inserted one at most one, so a common subsequence of L letters leaves m >= 3 L - a - b - 1.
The same m serves the whole name, its single words and the sorted words of the token set ratio, since spaced words hold the bigrams of any order.
The names of the highest bounds are scored first; all whose bound reaches the last of their best scores are scored after them. Names without a common
bigram are read only if such a name could reach that score. So results equal a scan of all names.

Null names, and names without a letter or digit, are never found. Equal names are listed once and found with each of their rows."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import search_name
from ..session import cut_lineage, release
from .search import name_score, searched_needle, tier_score

#: Names scored first, for each one asked for.
FIRST = 50


@dataclass(frozen=True)
class NameIndex:
    names: DataFrame  # the rows given, and `searched`
    grams: DataFrame  # gram, searched, times
    name: str
    key: str
    scoped: bool = False  # names are a part of those listed

    def within(self, **scope) -> NameIndex:
        """The part of the index of one value of each scope column named; the files of the names are sorted by them."""
        names = self.names
        for column, value in scope.items():
            names = names.where(F.col(column) == value)
        return NameIndex(names, self.grams, self.name, self.key, self.scoped or bool(scope))


def name_index(rows: DataFrame, name: str = "player_name", key: str = "player_id", scope: tuple[str, ...] = ()) -> NameIndex:
    """Writes both tables of the index, sorted so that a search skips what it does not ask for. A hot name or bigram is split over tasks by its rows."""
    order = [*scope, "searched", key]
    names = rows.withColumn("searched", search_name(F.col(name))).where(F.col("searched") != "")
    names = cut_lineage(names.repartitionByRange(*order).sortWithinPartitions(*order))
    letters = F.split(F.concat(F.lit(" "), F.replace("searched", F.lit(" "), F.lit("  ")), F.lit(" ")), "")
    pairs = F.transform(F.sequence(F.lit(0), F.size("_l") - 2), lambda i: F.concat(F.get("_l", i), F.get("_l", i + 1)))
    grams = names.select("searched").distinct().withColumn("_l", letters).select("searched", F.explode(pairs).alias("gram"))
    grams = cut_lineage(grams.where(F.col("gram") != "  ").groupBy("gram", "searched").agg(F.count(F.lit(1)).alias("times")))  # the sort reads it twice
    order = ["gram", "searched"]
    index = NameIndex(names, cut_lineage(grams.repartitionByRange(*order).sortWithinPartitions(*order)), name, key)
    release(grams)
    return index


def _letters_shared(text: Column, needle: str) -> Column:
    """Letters two texts have in common in any order, each as often as both hold it."""
    held = [F.least(F.lit(n), F.length(text) - F.length(F.replace(text, F.lit(c)))) for c, n in Counter(needle).items()]
    return F.aggregate(F.array(*held), F.lit(0), lambda s, x: s + x)


def _ratio_bound(shared: Column, a: int, b: Column, letters: Column) -> Column:
    return 200.0 * F.least(letters, F.floor((shared + a + b + 1) / 3)) / (b + a)


def score_bound(text: Column, shared: Column, needle: str) -> Column:
    """The tier, or else the most any of the ratios can be for a name that shares so many bigrams; no text has more in common than its letters."""
    asked = list(dict.fromkeys(needle.split()))
    words = F.split(text, " ")
    own = F.array_distinct(words)
    a, b = len(" ".join(asked)), F.length(F.array_join(own, " "))
    both = F.array_intersect(own, F.array(*map(F.lit, asked)))
    n, common = F.size(both), F.length(F.array_join(both, " "))
    letters = _letters_shared(text, needle)
    in_order = F.greatest(_ratio_bound(shared, a, b, letters), F.when(n > 0, 200.0 * F.greatest(common / (common + a), common / (common + b))))
    token_set = F.when((n > 0) & ((n == len(asked)) | (n == F.size(own))), 100.0).otherwise(in_order)
    single = F.array_max(F.transform(words, lambda w: _ratio_bound(shared, len(needle), F.length(w), _letters_shared(w, needle))))
    return F.coalesce(tier_score(text, needle), F.greatest(_ratio_bound(shared, len(needle), F.length(text), letters), token_set, 0.95 * single))


def bounded_names(index: NameIndex, needle: str) -> DataFrame:
    """(searched, bound) of the names that share a bigram with the needle."""
    asked = Counter(p for w in needle.split() for p in map("".join, zip(f" {w}", f"{w} ")))
    times = F.create_map(*[F.lit(x) for pair in asked.items() for x in pair])
    hits = index.grams.where(F.col("gram").isin(list(asked))).groupBy("searched").agg(F.sum(F.least("times", times[F.col("gram")])).alias("shared"))
    if index.scoped:
        hits = hits.join(index.names.select("searched").distinct(), "searched", "left_semi")
    return hits.select("searched", score_bound(F.col("searched"), F.col("shared"), needle).alias("bound"))


def survivors(index: NameIndex, needle: str, limit: int, floor: float) -> DataFrame:
    """(searched) of all names that may be among the best `limit`; only these are scored. Only scores of FIRST * limit names reach the driver."""
    if len(needle) < 2:  # one letter has no bigram: every name is a candidate
        return index.names.select("searched").distinct()
    bounded = bounded_names(index, needle)
    first = bounded.orderBy(F.col("bound").desc(), "searched").limit(FIRST * limit).select(name_score(F.col("searched"), needle).alias("s"))
    best = sorted((r["s"] for r in first.collect()), reverse=True)
    bar = max(floor, best[limit - 1]) - 1e-9 if len(best) >= limit else floor
    found = bounded.where(F.col("bound") >= bar).select("searched")
    # the most a name without a common bigram can reach, over all lengths: beyond 2 a + 1 letters it only falls
    a = {len(needle), len(" ".join(dict.fromkeys(needle.split())))}
    if max(200.0 * min(x, b, (x + b + 1) // 3) / (x + b) for x in a for b in range(1, 2 * x + 3)) < bar:
        return found
    others = index.names.select("searched").distinct().join(bounded.select("searched"), "searched", "left_anti")
    return found.unionByName(others.where(score_bound(F.col("searched"), F.lit(0), needle) >= bar))


def search_index(index: NameIndex, query: str, limit: int = 8, floor: float = 35.0) -> DataFrame:
    """The rows of the best names with their score, ties by name and id, as `search_players` finds them."""
    needle = searched_needle(query)
    if not needle or limit < 1:
        return index.names.withColumn("score", F.lit(0.0)).where("false").drop("searched")
    scored = survivors(index, needle, limit, floor).withColumn("score", name_score(F.col("searched"), needle)).where(F.col("score") >= floor)
    rows = index.names.join(scored, "searched")
    return rows.orderBy(F.col("score").desc(), F.lower(F.col(index.name)), index.key).limit(limit).drop("searched")
