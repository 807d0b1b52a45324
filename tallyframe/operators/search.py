"""Name search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import search_name


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit by bit."""
    marks: dict[str, int] = {}
    for i, ch in enumerate(a):
        marks[ch] = marks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & marks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - bin(state).count("1")


def indel_ratio(a: str, b: str) -> float:
    return 100.0 * 2 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, only_a, only_b = sorted(left & right), sorted(left - right), sorted(right - left)
    if both and (not only_a or not only_b):
        return 100.0
    base, x, y = " ".join(both), " ".join(both + only_a), " ".join(both + only_b)
    best = indel_ratio(x, y)
    return max(best, indel_ratio(base, x), indel_ratio(base, y)) if both else best


def tier_score(name: Column, needle: str) -> Column:
    """120 equal, 115 a word, 110 a word's start, 105 the start, 100 anywhere; null when only a fuzzy match is left."""
    words = F.split(name, " ")
    return (F.when(name == needle, 120.0).when(F.array_contains(words, needle), 115.0)
            .when(F.exists(words, lambda w: w.startswith(F.lit(needle))), 110.0)
            .when(name.startswith(needle), 105.0).when(name.contains(needle), 100.0))


def searched_needle(query: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split())


def name_score(text: Column, needle: str) -> Column:
    """The tier of a name, or else its best ratio, found in Arrow batches of the names without a tier."""

    def best(t: str | None) -> float | None:
        return max(indel_ratio(needle, t), token_set_ratio(needle, t), 0.95 * max(indel_ratio(needle, w) for w in t.split())) if t else None

    @F.pandas_udf("double")
    def fuzzy(texts: pd.Series) -> pd.Series:
        return texts.map(best).astype(float)

    tier = tier_score(text, needle)
    return F.coalesce(tier, fuzzy(F.when(tier.isNull(), text)))


def search_players(names: DataFrame, query: str, limit: int = 8, name: str = "player_name", key: str = "player_id",
                   floor: float = 35.0) -> DataFrame:
    """Best names, ties by name and id, in one scan of the names. For many searches of the same names see `name_index`."""
    needle = searched_needle(query)
    rows = names.withColumn("_n", search_name(F.col(name))).where(F.col("_n") != "").withColumn("score", name_score(F.col("_n"), needle))
    rows = rows.where(F.col("score") >= floor) if needle else rows.where("false")
    return rows.orderBy(F.col("score").desc(), F.lower(F.col(name)), key).limit(limit).drop("_n")


def subsequence_score(text: Column, query: str) -> Column:
    """100 for a prefix; else the compactness of the leftmost subsequence match, less up to 35 % for a late start."""
    q = query.strip().lower()
    t = F.lower(text)
    start = F.expr("named_struct('p', 0, 'first', 0)")

    def step(s, c):
        at = F.call_function("locate", c, t, s["p"] + 1)
        return F.when(s["p"] < 0, s).otherwise(F.struct(F.when(at == 0, -1).otherwise(at).alias("p"), F.when(s["first"] == 0, at).otherwise(s["first"]).alias("first")))

    got = F.aggregate(F.array(*map(F.lit, q)), start, step)
    fuzzy = F.when(got["p"] > 0, 100.0 * (len(q) / (got["p"] - got["first"] + 1)) * (1.0 - (got["first"] - 1) / F.length(t) * 0.35)).otherwise(0.0)
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, 0.0).when(t.startswith(q), 100.0).otherwise(fuzzy)


def team_score(query: str, abbreviation: Column, name: Column, nickname: Column) -> Column:
    q = query.strip().lower()
    short = F.lower(abbreviation)
    abbr = F.when(F.coalesce(F.length(short), F.lit(0)) == 0, 0.0).when(short == q, 100.0).when(short.startswith(q), 98.0).otherwise(subsequence_score(abbreviation, q))

    def field(c):
        words = F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), lambda w: subsequence_score(w, q))
        return F.greatest(subsequence_score(c, q), F.coalesce(F.array_max(words), F.lit(0.0)))

    return F.greatest(abbr, field(name), field(nickname))


def search_teams(metadata: DataFrame, query: str, limit: int = 6, floor: float = 35.0) -> DataFrame:
    """metadata: team_id, name, abbreviation, nickname."""
    if not query.strip():
        return metadata.withColumn("score", F.lit(0.0)).where("false")
    scored = metadata.withColumn("score", team_score(query, F.col("abbreviation"), F.col("name"), F.col("nickname")))
    return scored.where(F.col("score") >= floor).orderBy(F.col("score").desc(), F.lower("name"), "team_id").limit(limit)
