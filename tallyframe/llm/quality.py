"""Quality rules: base counts, then the divergence of a text's histograms from its language's reference.

Everything is DataFrame functions; no row leaves the JVM and no text is shuffled. Two histograms are compared with the
reference of the text's language by Jensen-Shannon distance (base 2, 0 to 1): classes of characters, and the most common
words of the language with all others as one bin. The references are sums over all documents of the language. Short texts
are guarded: below `min_chars` characters or `min_words` words a histogram says too little and its rule is not applied.

The common words are about 0.3 of a language, so a text with none of them is only about 0.4 away and `max_word_distance` does not see it.
`word_reach` = (a, b) measures the distance against that of such a text, the reach of the reference: a share whose square is over a + b / words
is rejected. b stands for chance, which shrinks with the length. It holds for texts of a language with a reference of its own only.

Null and empty texts have no words and fail the base rules. Documents without a language, or of a language with fewer than
`min_docs` documents, are held against the sum of the references. Equal rows are judged alike; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

SPACE = r"\x20\x09-\x0D"
CLASSES = ["lower", "space", "upper", "beyond_ascii", "digit", "mark", "symbol"]
WORD_REACH = (0.3, 25.0)  # set on sf0.01 and sf0.1: where clean texts end, from 0.88 of the reach at 52 words to 0.59 at 500
RULES = {"min_chars": 200, "min_words": 50, "max_class_distance": 0.3, "max_word_distance": 0.5, "word_reach": WORD_REACH}
COMMON_WORDS = 24
MIN_DOCS = 50
MAX_LANGUAGES = 200  # references kept and broadcast; rarer languages share the sum


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def repeated_words(tokens: Column, width: int = 8) -> Column:
    """Words inside windows of `width` (a power of two) that occur at least twice."""
    def doubled(hashes: Column, step: int) -> Column:
        return let(hashes, lambda h: F.zip_with(h, F.slice(h, F.lit(step + 1), F.size(h)), lambda a, b: F.xxhash64(a, b)))

    hashes, step = F.transform(tokens, lambda w: F.xxhash64(w)), 1
    while step < width:
        hashes, step = doubled(hashes, step), 2 * step
    windows = let(hashes, lambda h: F.slice(h, F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(0))))

    def covered(w):
        turns = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(turns, lambda t: F.filter(F.transform(t, lambda x, k: F.when(
            ((k > 0) & (x["h"] == F.get(t, k - 1)["h"])) | (x["h"] == F.get(t, k + 1)["h"]), x["i"])), lambda i: i.isNotNull()))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(F.sort_array(twice), start, lambda a, i: F.struct(
            (i + width).alias("end"), (a["n"] + width - F.greatest(F.lit(0), a["end"] - i)).alias("n")))["n"]

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))


def class_counts(text: Column) -> Column:
    """Counts in the order of CLASSES: each class is taken out of what the ones before have left."""
    cuts = ["[a-z]+", f"[{SPACE}]+", "[A-Z]+", r"[^\x00-\x7F]+", "[0-9]+", r"[^#*$%&|<>]+", r"[\s\S]+"]

    def step(rest: Column, k: int) -> Column:
        if k == len(cuts) - 1:
            return F.array(F.length(rest))
        return let(F.regexp_replace(rest, cuts[k], ""), lambda left: F.concat(F.array(F.length(rest) - F.length(left)), step(left, k + 1)))

    return let(text, lambda t: step(t, 0))


def plain_words(text: Column) -> Column:
    """Lower-case letter runs, each with a space before and behind."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", "  ")), F.lit(" "))


def n_plain(plain: Column) -> Column:
    """How many words plain_words holds: one more than the double spaces between them."""
    return F.when(F.octet_length(plain) > 2, F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit("  "), F.lit(" "))) + 1).otherwise(F.lit(0))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of one length."""
    def share(a):
        return let(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))

    def part(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(share(p), share(q), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def references(docs: DataFrame, common: int = COMMON_WORDS) -> DataFrame:
    """(lang, ref_classes, ref_words, ref_counts): at most MAX_LANGUAGES + 1 rows; the row without lang is the sum of all."""
    rows = docs.select("lang", F.coalesce("text", F.lit("")).alias("text"))
    marked = rows.select("lang", class_counts(F.col("text")).alias("c"))
    sums = marked.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), *[F.sum(F.col("c")[i]).alias(n) for i, n in enumerate(CLASSES)])
    sums = cut_lineage(sums)
    exploded = rows.select("lang", F.explode(F.split(plain_words(F.col("text")), " +")).alias("word")).filter("word <> ''")
    counts = exploded.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    turn = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    first = counts.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= common).select("lang", "word", "n")
    all_words = counts.groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("word"), "n")
    pool = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(common).select(F.lit(None).cast("string").alias("lang"), "word", "n")
    found = cut_lineage(first.unionByName(all_words).withColumn("pooled", F.lit(False)).unionByName(pool.withColumn("pooled", F.lit(True))))  # one pass over the words
    top = found.filter("word is not null and not pooled").drop("pooled")
    totals = found.filter("word is null").select("lang", F.col("n").alias("words"))
    ranked = sums.filter(F.col("lang").isNotNull() & (F.col("docs") >= MIN_DOCS)).orderBy(F.desc("docs"), "lang").limit(MAX_LANGUAGES)
    kept = ranked.select("lang")

    def shaped(sums: DataFrame, top: DataFrame, totals: DataFrame, key: list[str]) -> DataFrame:
        lists = top.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("n", "word")), asc=False).alias("l"))
        out = sums.select(*key, F.array(*[F.col(c).cast("double") for c in CLASSES]).alias("ref_classes"))
        both = lists.join(totals, key) if key else lists.crossJoin(totals)
        both = both.select(*key, F.transform("l", lambda x: x["word"]).alias("ref_words"), F.concat(
            F.transform("l", lambda x: x["n"].cast("double")),
            F.array((F.col("words") - F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x["n"])).cast("double"))).alias("ref_counts"))
        return out.join(both, key, "left") if key else out.crossJoin(both)

    each = shaped(ranked, top.join(kept, "lang", "left_semi"), totals, ["lang"])
    whole = shaped(sums.agg(*[F.sum(c).alias(c) for c in CLASSES]), found.filter("pooled").select("word", "n"), totals.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words")), [])
    return each.unionByName(whole.withColumn("lang", F.lit(None).cast("string")))


def judged(docs: DataFrame, rules: dict | None = None, common: int = COMMON_WORDS) -> DataFrame:
    """docs (text, lang, and any columns to keep) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    class_distance, word_distance (null where guarded), base_failed and kept."""
    rules = {**RULES, **(rules or {})}
    own = docs.columns
    refs = references(docs, common).select(F.col("lang").alias("_ref"), *["ref_classes", "ref_words", "ref_counts"])
    no_common = F.transform("ref_counts", lambda x, k: F.when(k == F.size("ref_words"), F.lit(1.0)).otherwise(F.lit(0.0)))
    known = refs.filter("_ref is not null").withColumn("_reach", distance(no_common, F.col("ref_counts")))
    whole = refs.filter("_ref is null").select(*[F.col(c).alias(f"_{c}") for c in refs.columns[1:]])
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    rows = docs.select(
        *own, class_counts(text).alias("_classes"), plain_words(text).alias("_plain"),
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("_w"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    rows = rows.join(F.broadcast(known), rows["lang"] == known["_ref"], "left").crossJoin(F.broadcast(whole))
    ref = {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in ("ref_classes", "ref_words", "ref_counts")}
    own_counts = let(F.transform(ref["ref_words"], lambda w: (
        (F.octet_length("_plain") - F.octet_length(F.replace(F.col("_plain"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2))),
        lambda c: F.concat(c, F.array(F.greatest(F.lit(0.0), n_plain(F.col("_plain")) - F.aggregate(c, F.lit(0.0), lambda s, x: s + x)))))
    n_words, chars = F.col("_w")["n_words"], F.aggregate("_classes", F.lit(0), lambda s, x: s + x)
    as_double = F.transform("_classes", lambda x: x.cast("double"))
    rows = rows.select(
        *own, n_words.alias("n_words"), (chars - F.col("_classes")[1]).cast("long").alias("word_chars"), F.col("_classes")[6].cast("long").alias("n_symbols"),
        "n_dup_lines", F.col("_w")["n_repeat_words"].alias("n_repeat_words"),
        F.when((chars >= rules["min_chars"]) & (n_words >= rules["min_words"]), distance(as_double, ref["ref_classes"])).alias("class_distance"),
        F.when(n_words >= rules["min_words"], distance(own_counts, ref["ref_counts"])).alias("word_distance"), "_reach")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = ~failed & (F.coalesce("class_distance", F.lit(0.0)) <= rules["max_class_distance"]) & (F.coalesce("word_distance", F.lit(0.0)) <= rules["max_word_distance"])
    if rules["word_reach"]:
        a, b = rules["word_reach"]
        limit = (a + b / F.col("n_words")) * F.col("_reach") * F.col("_reach")
        good = good & F.coalesce(F.col("word_distance") * F.col("word_distance") <= limit, F.lit(True))
    return rows.withColumn("base_failed", failed).withColumn("kept", good).drop("_reach")
