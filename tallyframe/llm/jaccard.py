"""N-gram Jaccard join with count vectors in R-trees.

A text's set holds its distinct five-word shingles as 64-bit hashes. Equal sets are one node (its digest). Two sets can link only
if they share one of their first n - ceil(0.75 n) + 1 shingles in a common order; shingles that many texts have come last in that
order (which ones is found by counting over all texts; the order bears on speed alone, never on results). Sharing such a
shingle makes a list of candidates. In order of size a list falls into runs, cut where the next size is too large for a link. Runs of one set
hold no link, and the one pair of a run of two is seen in round 1. Runs of three or more with the same smallest digest, the pivot, are one
group: the lists of a passage or of a family of copies have the same members, and each is held once.

Shingles are also hashed into groups, n/2 to n of them, and the group counts are the set's point. The overlap of two sets is at most the
sum of the smaller coordinates, so a pair is dropped if that is below 3/7 of both sizes. Three rounds find all links:
1. In each list every set is paired with the smallest of its size range; pairs that pass the bound are verified. This
   joins families of copies without all their pairs.
2. Groups that still hold several components are split into blocks, each pair of blocks gets an R-tree over its points
   (pages in size order, nodes with the maxima of their points). Of the pairs whose nodes and points pass the bound the best one
   of every two components is verified, which joins most of the rest. A group where no pair was left aside is done.
3. The others again with the new components, and all pairs from different components that pass the bound are verified.
No pair is verified twice. A link that was never verified joins sets that are in one component already.

Null, empty and blank texts have no shingles and stand alone; a text of one to four words is one shingle. Equal ids are told apart by
`identified`. Sets are compared by 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.rows import Words, bitmap_filter, byte_map, components, mixed, text_groups
from tallyframe.session import cut_lineage

WIDTH = 5
COMMON = 100_000  # frequent shingles that come last in the order; a bound on what is broadcast
COMMON_LEAST = 32
BLOCK = 1024
PAGE = 16
NODE_GROUPS = 16
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: Words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    _, _, h, text = words.find(data, offsets)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    if len(h) >= WIDTH:
        rolled = h[: len(h) - WIDTH + 1] * _STEPS[0]
        for k in range(1, WIDTH):
            rolled = rolled + h[k : len(h) - WIDTH + 1 + k] * _STEPS[k]
        rolled = mixed(rolled)
    out = []
    for i in range(len(offsets) - 1):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= WIDTH:
            s = np.sort(rolled[a : b - WIDTH + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mixed(np.array([(h[a:b] * _STEPS[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digest_of(s: np.ndarray) -> int:
    return int(mixed(np.array([mixed(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def needed(a, b):
    """The least overlap of sets of these sizes that link: 100 i >= 75 (a + b - i)."""
    return (3 * (a + b) + 6) // 7


def point(s: np.ndarray) -> np.ndarray:
    """Counts of at most one or two shingles a group on average; hashes of distinct shingles never fill a byte."""
    groups = max(NODE_GROUPS, 1 << (max(1, len(s)).bit_length() - 1))
    return np.minimum(np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Counts for fewer groups (powers of two)."""
    return points.reshape(len(points), -1, groups).sum(1, dtype=np.int64)


# ---- passes over the texts -----------------------------------------------------------------------------------------------------


def _count_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, seen, held, size = Words(byte_map("space")), set(), [], 0

    def counted():
        if held:
            s = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            n = np.diff(np.append(at, len(s)))
            many = n >= 4
            yield pa.RecordBatch.from_arrays([pa.array(s[at][many].view(np.int64)), pa.array(n[many].astype(np.int64))], names=["shingle", "n"])

    for _, data, offsets in text_groups(batches, "text"):
        for s in shingle_sets(data, offsets, words):
            if len(s) and (d := digest_of(s)) not in seen:
                seen.add(d)
                held.append(s)
                size += len(s)
        if size > 2_000_000:
            yield from counted()
            held, size = [], 0
    yield from counted()


class Order:
    """Rare shingles first (by hash), then the common ones by how many texts have them."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        turn = np.argsort(shingles)
        self.shingles = shingles[turn]
        self.rank = np.empty(len(shingles), np.int64)
        self.rank[np.lexsort((shingles, counts))] = np.arange(len(shingles))
        self.rank = self.rank[turn]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(shingles >> np.uint64(44)).astype(np.int64)] = True

    def prefix(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        take = n - (3 * n + 3) // 4 + 1
        look = np.flatnonzero(self.maybe[(s >> np.uint64(44)).astype(np.int64)])
        if len(look) and len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, s[look]), len(self.shingles) - 1)
            hit = self.shingles[at] == s[look]
            if hit.any():
                common = look[hit][np.argsort(self.rank[at[hit]])]
                rare = np.ones(n, bool)
                rare[common] = False
                s = np.concatenate([s[rare], s[common]])
        return s[:take]


def _describe(order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, by, seen = Words(byte_map("space")), order.value, set()
        for batch, data, offsets in text_groups(batches, "text"):
            uid, n, digest, prefix, vector = batch.column("uid"), [], [], [], []
            for s in shingle_sets(data, offsets, words):
                n.append(len(s))
                d = digest_of(s) if len(s) else None
                digest.append(d)
                new = d is not None and d not in seen  # a task describes equal sets once
                seen.add(d)
                prefix.append(by.prefix(s).tobytes() if new else None)
                vector.append(point(s).tobytes() if new else None)
            yield pa.RecordBatch.from_arrays(
                [uid, pa.array(n, pa.int64()), pa.array(digest, pa.int64()), pa.array(prefix, pa.binary()), pa.array(vector, pa.binary())],
                names=["uid", "n", "digest", "prefix", "vector"])

    return run


# ---- lists of sets that share a shingle of their prefixes ----------------------------------------------------------------------


def _dealt(buckets: int):
    """Postings (shingle, digest, size), packed by bucket of the shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def packed():
            shingle = np.concatenate([h[0] for h in held])
            lengths = [len(h[0]) for h in held]
            digest = np.repeat(np.array([h[1] for h in held], np.int64), lengths)
            n = np.repeat(np.array([h[2] for h in held], np.int32), lengths)
            bucket = ((shingle >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            turn = np.argsort(bucket, kind="stable")
            bucket, shingle, digest, n = bucket[turn], shingle[turn], digest[turn], n[turn]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            low = (shingle & np.uint64(0xFFFFFFFF)).astype(np.uint32)  # with the bucket this tells shingles apart; a rare mix-up adds a candidate
            blobs = [low[a:b].tobytes() + n[a:b].tobytes() + digest[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), pa.array(blobs, pa.binary())], names=["bucket", "postings"])

        size = 0
        for batch in batches:
            for d, n, p in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "prefix"))):
                held.append((np.frombuffer(p, np.uint64), d, n))
                size += len(p) // 8
            if size > 1_000_000:
                yield packed()
                held.clear()
                size = 0
        if held:
            yield packed()

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the lists of a partition, each pair once: (pivot, member, size of the member, False) for all members of a run of three or more, the
    pivot among them; and (first of a size range, member, 0, True)."""
    shingle, digest, n = [], [], []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("postings").to_pylist()):
            k = len(blob) // 16
            shingle.append(np.frombuffer(blob, np.uint32, k) | np.uint64(bucket << 32))
            n.append(np.frombuffer(blob, np.int32, k, 4 * k))
            digest.append(np.frombuffer(blob, np.int64, k, 8 * k))
    if not shingle:
        return
    shingle, digest, n = map(np.concatenate, (shingle, digest, n))
    turn = np.argsort(shingle)
    s = shingle[turn]
    same = s[1:] == s[:-1]
    turn = turn[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    turn = turn[np.lexsort((digest[turn], n[turn], shingle[turn]))]
    shingle, digest, n = shingle[turn], digest[turn], n[turn].astype(np.int64)
    keep = np.ones(len(shingle), bool)
    keep[1:] = (shingle[1:] != shingle[:-1]) | (digest[1:] != digest[:-1])
    shingle, digest, n = shingle[keep], digest[keep], n[keep]
    if not len(shingle):
        return
    cut = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
    many = np.diff(np.append(cut, len(shingle)))
    run = np.flatnonzero(np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (4 * n[:-1] < 3 * n[1:])]))
    long = np.diff(np.append(run, len(shingle)))
    pivot = np.repeat(np.minimum.reduceat(digest, run), long)
    grouped = np.repeat(long > 2, long)
    first = np.repeat(cut, many)  # of the size range; ranges after the first of a list are found step by step
    late = np.flatnonzero(4 * n[first] < 3 * n)
    while len(late):
        lists = first[late]
        begin = late[np.concatenate([[True], lists[1:] != lists[:-1]])]
        first[late] = np.repeat(begin, np.diff(np.append(np.searchsorted(late, begin), len(late))))
        late = late[4 * n[first[late]] < 3 * n[late]]
    star = first != np.arange(len(first))
    for a, b, size, is_star in ((pivot[grouped], digest[grouped], n[grouped], False), (digest[first[star]], digest[star], None, True)):
        size = np.zeros(len(a), np.int64) if size is None else size
        turn = np.lexsort((b, a))
        a, b, size = a[turn], b[turn], size[turn]
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, size = a[keep], b[keep], size[keep]
        for at in range(0, len(a), 1 << 16):
            few = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(a[few]), pa.array(b[few]), pa.array(size[few]), pa.array(np.full(len(a[few]), is_star))], names=["a", "b", "n", "star"])


# ---- the bound, the trees and the exact check ----------------------------------------------------------------------------------


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose points allow a link."""
    for batch in batches:
        keep = []
        for va, vb, na, nb in zip(*(batch.column(c).to_pylist() for c in ("va", "vb", "na", "nb"))):
            p, q = np.frombuffer(va, np.uint8), np.frombuffer(vb, np.uint8)
            if len(p) != len(q):
                g = min(len(p), len(q))
                p, q = folded(p[None], g)[0], folded(q[None], g)[0]
            keep.append(int(np.minimum(p, q).sum(dtype=np.int64)) >= needed(na, nb))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class CountTree:
    """Points in order of size, in pages; a node holds the largest count of each coarse group and the size range below it."""

    def __init__(self, points: list[np.ndarray], sizes: np.ndarray):
        self.turn = np.argsort(sizes, kind="stable")
        self.points, self.sizes = [points[i] for i in self.turn], sizes[self.turn]
        top = np.stack([folded(p[None].astype(np.int64), NODE_GROUPS)[0] for p in self.points])
        low, high = self.sizes, self.sizes
        self.levels = []
        while True:
            at = np.arange(0, len(top), PAGE)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))
            if len(top) == 1:
                break

    def pages(self) -> np.ndarray:
        """Pairs of pages (i <= j) that can hold a link, by descent from the root with itself."""
        pairs = np.zeros((1, 2), np.int64)
        for k, (top, low, high) in enumerate(reversed(self.levels)):
            if k:
                step = np.arange(PAGE)
                i = (pairs[:, 0, None, None] * PAGE + step[None, :, None]) + 0 * step
                j = (pairs[:, 1, None, None] * PAGE + step[None, None, :]) + 0 * step[:, None]
                pairs = np.stack([i.ravel(), j.ravel()], 1)
                pairs = pairs[(pairs[:, 0] <= pairs[:, 1]) & (pairs < len(top)).all(1)]
            i, j = pairs.T
            fits = 4 * high[i] >= 3 * low[j]
            pairs, i, j = pairs[fits], i[fits], j[fits]
            pairs = pairs[np.minimum(top[i], top[j]).sum(1) >= needed(low[i], low[j])]
        return pairs

    def join(self, label: np.ndarray, one_each: bool = False) -> np.ndarray:
        """Pairs of places (into the given points) with different labels that pass the bound; with `one_each` the pair of every two labels that
        passes it best, and `left_aside` tells whether there were more."""
        label, out, spare, self.left_aside = label[self.turn], [], [], False
        for i, j in (self.pages() if len(self.sizes) > PAGE else [(0, 0)]):
            a, b = np.arange(i * PAGE, min((i + 1) * PAGE, len(label))), np.arange(j * PAGE, min((j + 1) * PAGE, len(label)))
            groups = min(len(self.points[a[0]]), len(self.points[b[0]]))
            p, q = (np.stack([folded(self.points[x][None], groups)[0] for x in side]) for side in (a, b))
            least = needed(self.sizes[a][:, None], self.sizes[b][None, :])
            over = np.minimum(p[:, None], q[None]).sum(2) - least
            good = (over >= 0) & (label[a][:, None] != label[b][None, :])
            if i == j:
                good &= np.triu(np.ones_like(good), 1)
            x, y = np.nonzero(good)
            out.append(np.stack([a[x], b[y]], 1))
            spare.append(over[x, y] / least[x, y])
        pairs = np.concatenate(out)
        if one_each and len(pairs):
            spare, two = np.concatenate(spare), np.sort(label[pairs], axis=1)
            order = np.lexsort((-spare, two[:, 1], two[:, 0]))
            two = two[order]
            first = np.concatenate([[True], (two[1:] != two[:-1]).any(1)])
            pairs, self.left_aside = pairs[order[first]], not first.all()
        return self.turn[pairs]


def _trees(batches: Iterator[pa.RecordBatch], one_each: bool) -> Iterator[pa.RecordBatch]:
    """One tree per group and pair of blocks; rows come sorted by them. A row (pivot, null) marks a group where pairs were left aside."""
    held: list = []

    def joined(rows: list) -> pa.RecordBatch | None:
        if len(rows) < 2 or len({r[4] for r in rows}) < 2:
            return None
        digest = np.array([r[2] for r in rows], np.int64)
        tree = CountTree([np.frombuffer(r[5], np.uint8) for r in rows], np.array([r[3] for r in rows], np.int64))
        x, y = tree.join(np.array([r[4] for r in rows], np.int64), one_each).T
        if not len(x):
            return None
        a, b = np.minimum(digest[x], digest[y]).tolist(), np.maximum(digest[x], digest[y]).tolist()
        if tree.left_aside:
            a.append(rows[0][0])
            b.append(None)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("pivot", "block", "digest", "n", "label", "vector"))):
            if held and held[-1][:2] != row[:2]:
                if (done := joined(held)) is not None:
                    yield done
                held = []
            held.append(row)
    if (done := joined(held)) is not None:
        yield done


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words(byte_map("space"))
    for batch in batches:
        for part, data, offsets in text_groups(iter([batch]), "text_a"):
            left = shingle_sets(data, offsets, words)
            right = [s for _, d, o in text_groups(iter([part]), "text_b") for s in shingle_sets(d, o, words)]
            keep = []
            for p, q in zip(left, right):
                both = np.sort(np.concatenate([p, q]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= 75 * (len(p) + len(q) - same))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """docs (uid, text) -> (uid, n_shingles, component): the smallest uid reachable by links of similarity 0.75 or more."""
    spark = docs.sparkSession
    rows = docs.select("uid", "text")
    common = rows.mapInArrow(_count_common, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    common = common.filter(F.col("n") >= COMMON_LEAST).orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    order = spark.sparkContext.broadcast(Order(
        np.array([r["shingle"] for r in common], np.int64).view(np.uint64), np.array([r["n"] for r in common], np.int64)))
    sets = cut_lineage(rows.mapInArrow(_describe(order), "uid long, n long, digest long, prefix binary, vector binary"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (sets.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0) // 600_000)
    partitions = int(partitions)
    postings = sets.filter("prefix is not null").select("digest", "n", "prefix").mapInArrow(_dealt(8 * partitions), "bucket int, postings binary")
    found = cut_lineage(postings.repartition(partitions, "bucket").mapInArrow(_lists, "a long, b long, n long, star boolean"))
    vectors = sets.filter("vector is not null").groupBy("digest").agg(F.first("n").alias("n"), F.first("vector").alias("vector"), F.min("uid").alias("rep"))
    first_of = sets.filter("digest is not null").groupBy("digest").agg(F.min("uid").alias("rep"))

    def exact(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
        reps = cut_lineage(first_of.join(ends, "digest"))
        texts = bitmap_filter(rows, "uid", reps.select("rep")).join(reps, F.col("uid") == F.col("rep")).select("digest", "text")
        texts = cut_lineage(texts)
        a, b = (texts.select(F.col("digest").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        return cut_lineage(pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long"))

    def with_vectors(pairs: DataFrame) -> DataFrame:
        a, b = (vectors.select(F.col("digest").alias(x), F.col("n").alias(f"n{x}"), F.col("vector").alias(f"v{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b")

    stars = found.filter("star").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = cut_lineage(with_vectors(stars).mapInArrow(_bounded, "a long, b long"))
    links = exact(tried)
    members = cut_lineage(found.filter("not star").select(F.col("a").alias("pivot"), F.col("b").alias("digest"), "n").distinct())

    def searched(members: DataFrame, links: DataFrame, one_each: bool) -> DataFrame:
        """Pairs (a, b) between different components of `links` that pass the bound; with `one_each` also (pivot, null) of groups not done."""
        labels = components(links).withColumnRenamed("node", "digest")
        rows = cut_lineage(members.join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest")))
        mixed_groups = rows.groupBy("pivot").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("m")).filter("x <> y")
        dealt = rows.join(mixed_groups.select("pivot", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "pivot")
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumn("block", F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other"))
        dealt = dealt.select("pivot", "block", "digest", "n", "label").join(vectors.select("digest", "vector"), "digest")
        dealt = dealt.repartition("pivot", "block").sortWithinPartitions("pivot", "block").select("pivot", "block", "digest", "n", "label", "vector")
        return cut_lineage(dealt.mapInArrow(lambda batches: _trees(batches, one_each), "a long, b long").distinct())

    best = searched(members, links, True)
    pairs = cut_lineage(best.filter("b is not null").join(tried, ["a", "b"], "left_anti"))
    links, tried = links.unionByName(exact(pairs)), tried.unionByName(pairs)
    undone = members.join(best.filter("b is null").select(F.col("a").alias("pivot")), "pivot", "left_semi")
    more = exact(cut_lineage(searched(undone, links, False).join(tried, ["a", "b"], "left_anti")))
    whole = components(links.unionByName(more))

    groups = first_of.join(whole, first_of["digest"] == whole["node"], "left").select("digest", "rep", F.coalesce("label", "digest").alias("label"))
    smallest = groups.groupBy("label").agg(F.min("rep").alias("component"))
    found = cut_lineage(groups.join(smallest, "label").select("digest", "component"))
    return sets.select("uid", F.col("n").alias("n_shingles"), "digest").join(found, "digest", "left").select(
        "uid", "n_shingles", F.coalesce("component", "uid").alias("component"))
