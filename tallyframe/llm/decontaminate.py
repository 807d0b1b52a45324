"""Benchmark decontamination with an FM-index per shard of training texts.

Each task takes whole texts up to a shard's size, numbers their words by the benchmark's vocabulary (runs of other words
and text ends become one stop symbol), sorts all suffixes, and keeps the Burrows-Wheeler transform as a wavelet matrix,
with every sixteenth text position. Test phrases are searched backwards, all at once; occurrences are located by walking
to a sampled position, and their spans are merged. No text is shuffled.

Null and empty texts have no words. A phrase is `width` consecutive words of an item, or all words of a shorter item; items
without words are never found. Equal items under several ids are each listed; a null id is listed as "null". Equal rows of
the documents each get a result. The benchmark is cut into blocks of bounded size and each block makes a pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.rows import Words, byte_map, text_groups

WIDTH = 10
SAMPLE = 16
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20


class Wavelet:
    """Rank and access over symbols in [0, size) as a wavelet matrix."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            count = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(symbols) - int(count[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros_like(at)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one, zeros = ((symbol >> level) & 1).astype(bool), self.zeros[k]
            a, b = self.ones[k][low], self.ones[k][at]
            low = np.where(one, zeros + a, low - a)
            at = np.where(one, zeros + b, at - b)
        return at - low


def suffix_order(seq: np.ndarray, size: int) -> np.ndarray:
    """Places of `seq` in the order of their suffixes, by doubling; only suffixes still tied are sorted again."""
    n = len(seq)
    bits = max(1, int(size - 1).bit_length())
    depth = 62 // bits
    padded = np.concatenate([seq.astype(np.int64), np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    heads = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[order] = heads[np.cumsum(new) - 1]
    rank[n] = -1
    while True:
        sizes = np.diff(np.append(heads, n))
        tied = np.repeat(sizes > 1, sizes)
        if not tied.any():
            return order
        at = np.flatnonzero(tied)
        rows = order[at]
        group, following = rank[rows], rank[np.minimum(rows + depth, n)]
        turn = np.lexsort((following, group))
        rows, group, following = rows[turn], group[turn], following[turn]
        order[at] = rows
        split = np.ones(len(rows), bool)
        split[1:] = (group[1:] != group[:-1]) | (following[1:] != following[:-1])
        begins = np.flatnonzero(split)
        rank[rows] = at[begins][np.cumsum(split) - 1]
        marks = np.zeros(n, bool)
        marks[heads] = True
        marks[at[begins]] = True
        heads = np.flatnonzero(marks)
        depth *= 2


class FMIndex:
    """Backward search over symbols in [1, size); 0 is the end mark and is not in `seq`."""

    def __init__(self, seq: np.ndarray, size: int, sample: int = SAMPLE):
        whole = np.append(seq, 0)
        order = suffix_order(whole, size)
        self.bwt = whole[order - 1]
        self.before = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(whole, minlength=size), out=self.before[1:])
        self.wavelet = Wavelet(self.bwt.astype(np.int32), size)
        self.sampled = order % sample == 0
        self.nth = np.cumsum(self.sampled) - 1
        self.places = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; phrases stand at the right of their row of symbols."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        width = phrases.shape[1]
        for back in range(1, width + 1):
            live = np.flatnonzero((low < high) & (lengths >= back))
            if not len(live):
                break
            c = phrases[live, width - back]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled[rows[todo]]
            ready = todo[done]
            out[ready] = self.places[self.nth[rows[ready]]] + steps
            todo = todo[~done]
            c = self.bwt[rows[todo]]
            rows[todo] = self.before[c] + self.wavelet.rank(c, rows[todo])
            steps += 1
        return out


class Phrases:
    """The windows of a block of items: distinct windows as symbols, and the items each belongs to."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.ids = sorted({"null" if i is None else i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        words = Words(byte_map("alnum"))
        windows: dict[tuple[int, ...], set[int]] = {}
        for i, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            hashes = words.find(data, np.array([0, len(data)]))[2].tolist()
            for k in range(max(1, len(hashes) - width + 1) if hashes else 0):
                windows.setdefault(tuple(hashes[k : k + width]), set()).add(number["null" if i is None else i])
        self.vocabulary = np.unique(np.array([h for w in windows for h in w], np.uint64))
        self.size = len(self.vocabulary) + 2  # 0: end, 1: anything else
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.symbols = np.zeros((len(windows), width), np.int64)
        for k, w in enumerate(windows):
            self.symbols[k, width - len(w) :] = np.searchsorted(self.vocabulary, np.array(w, np.uint64)) + 2
        self.of_items = [sorted(s) for s in windows.values()]


def _search_shard(data: np.ndarray, offsets: np.ndarray, p: Phrases, words: Words) -> dict:
    """Word counts per text, merged spans (text, first word, end word, first byte, end byte) and (text, item) pairs."""
    start, end, hashes, text = words.find(data, offsets)
    n_texts = len(offsets) - 1
    counts = np.bincount(text, minlength=n_texts)
    none = np.empty(0, np.int64)
    out = {"counts": counts, "span": [none] * 5, "pair": [none, none]}
    if not len(hashes) or not len(p.lengths):
        return out
    at = np.minimum(np.searchsorted(p.vocabulary, hashes), len(p.vocabulary) - 1)
    symbol = np.where(p.vocabulary[at] == hashes, at + 2, 1)
    first_words = np.concatenate([[0], np.cumsum(counts)])
    # a stop symbol goes before each text's first word, then runs of stops become one
    where = np.arange(len(symbol)) + text + 1
    seq = np.ones(len(symbol) + n_texts, np.int64)
    seq[where] = symbol
    word_of = np.full(len(seq), -1, np.int64)
    word_of[where] = np.arange(len(symbol))
    keep = np.ones(len(seq), bool)
    keep[1:] = (seq[1:] != 1) | (seq[:-1] != 1)
    seq, word_of = seq[keep], word_of[keep]
    if len(seq) <= 1:
        return out
    index = FMIndex(seq, p.size)
    low, high = index.search(p.symbols, p.lengths)
    found = np.flatnonzero(low < high)
    if not len(found):
        return out
    many = (high - low)[found]
    phrase = np.repeat(found, many)
    rows = np.repeat(low[found], many) + np.arange(len(phrase)) - np.repeat(np.cumsum(many) - many, many)
    word = word_of[index.locate(rows)]
    cover = np.zeros(len(symbol) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + p.lengths[phrase], -1)
    hit = np.cumsum(cover[:-1]) > 0
    begins = hit.copy()
    begins[1:] &= ~hit[:-1] | (text[1:] != text[:-1])
    stops = hit.copy()
    stops[:-1] &= ~hit[1:] | (text[1:] != text[:-1])
    b, e = np.flatnonzero(begins), np.flatnonzero(stops)
    t = text[b]
    out["span"] = [t, b - first_words[t], e + 1 - first_words[t], start[b] - offsets[t], end[e] - offsets[t]]
    owners = np.concatenate([np.array(p.of_items[k], np.int64) for k in phrase])
    pairs = np.unique(np.stack([np.repeat(text[word], [len(p.of_items[k]) for k in phrase]), owners]), axis=1)
    out["pair"] = [pairs[0], pairs[1]]
    return out


SPAN = "array<struct<first_word:int,end_word:int,first_byte:int,end_byte:int>>"
_SPAN = pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("first_byte", pa.int32()), ("end_byte", pa.int32())])


def _searcher(block, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, words = block.value, Words(byte_map("alnum"))

        def shard(group: list) -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, _, o in group]))])
            got = _search_shard(np.concatenate([d for _, d, _ in group]), offsets, p, words)
            n = len(offsets) - 1
            t, *span = got["span"]
            cuts = pa.array(np.searchsorted(t, np.arange(n + 1)), pa.int32())
            spans = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in span], fields=list(_SPAN)))
            t, item = got["pair"]
            cuts = pa.array(np.searchsorted(t, np.arange(n + 1)), pa.int32())
            items = pa.ListArray.from_arrays(cuts, pa.array([p.ids[k] for k in item], pa.string()))
            whole = pa.Table.from_batches([b for b, _, _ in group]).select(carried).combine_chunks()
            columns = [whole.column(c).combine_chunks() for c in carried]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            return pa.RecordBatch.from_arrays([*columns, pa.array(got["counts"], pa.int64()), spans, items], names=[*carried, "n_words", "spans", "items"])

        group, size = [], 0
        for piece in text_groups(batches, "text", SHARD_BYTES):
            if group and size + len(piece[1]) > SHARD_BYTES:
                yield shard(group)
                group, size = [], 0
            group.append(piece)
            size += len(piece[1])
        if group:
            yield shard(group)

    return run


def found_phrases(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """docs (uid, text, ...) and benchmark (item_id, text) -> (uid, carried columns, n_words, spans, items): `spans` are merged
    and in order, with word and byte places; `items` are the ids with occurring windows."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // BLOCK_BYTES) or 1
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    carried = list(dict.fromkeys(["uid", *carry]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema.fields)
    schema += f", n_words bigint, spans {SPAN}, items array<string>"
    needed = docs.select(*dict.fromkeys([*carried, "text"]))
    parts = []
    for k in range(n_blocks):
        block = items if n_blocks == 1 else items.filter(block_of == k)
        phrases = Phrases([(r["item_id"], r["text"]) for r in block.collect()], width)
        parts.append(needed.mapInArrow(_searcher(spark.sparkContext.broadcast(phrases), carried), schema))
    if n_blocks == 1:
        return parts[0]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))), F.expr(f"cast(array() as {SPAN})"),
        lambda done, s: F.when((F.size(done) == 0) | (s["first_word"] > F.element_at(done, -1)["end_word"]), F.concat(done, F.array(s))).otherwise(
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["first_word"].alias("first_word"), F.greatest(F.element_at(done, -1)["end_word"], s["end_word"]).alias("end_word"),
                F.element_at(done, -1)["first_byte"].alias("first_byte"), F.greatest(F.element_at(done, -1)["end_byte"], s["end_byte"]).alias("end_byte"))))))
    return both.groupBy("uid").agg(
        *[F.first(c).alias(c) for c in carried if c != "uid"], F.first("n_words").alias("n_words"),
        merged.alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def without_spans(text: str, spans: str):
    """Column: the text without the bytes of its spans."""
    data = F.encode(F.col(text), "UTF-8")
    kept = F.aggregate(
        F.col(spans), F.struct(F.lit(0).alias("at"), F.encode(F.lit(""), "UTF-8").alias("out")),
        lambda s, x: F.struct(x["end_byte"].alias("at"), F.concat(s["out"], F.substring(data, s["at"] + 1, x["first_byte"] - s["at"])).alias("out")))
    rest = F.concat(kept["out"], F.substring(data, kept["at"] + 1, F.length(data) - kept["at"]))
    return F.when(F.size(spans) == 0, F.col(text)).otherwise(F.decode(rest, "UTF-8"))
