"""Suffix-array deduplication with a depth-limited radix sort.

Every suffix is ordered through its first `WIDTH` bytes only, by most-significant-digit passes that drop a suffix as soon as it is
alone in its group; the groups left at the end are exactly the repeated windows, and all but the first of each are removed.

The first digit is the window's anchor, its smallest 24-byte gram by hash, with the place of it in the window. Consecutive windows
share an anchor, so this pass handles one run per anchor (about one in forty bytes) and not every suffix. A run is known by its
gram and by a hash of all its bytes: of equal runs only the first goes on, the others are repeats throughout. Only runs
whose gram is shared by different runs have their bytes fetched, in a second pass over the texts, and their windows
sorted by the remaining digits of 25 bytes each. Of a gram with very many different runs no bytes are shuffled: where its texts are read, each of its
windows is hashed through all digits, the first of equal windows in the task goes on, and it is dealt by that hash, so that such a gram
spreads over all tasks and only equal windows meet.

Null texts are empty. Texts under 100 bytes lose nothing. Of texts equal throughout the first stays whole and the others
lose everything. Equal ids are told apart by `identified`. Stretches are compared by 64-bit hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.rows import Words, bitmap_filter, mixed, text_groups
from tallyframe.session import cut_lineage

WIDTH = 100
GRAM = 24
DIGITS = (25, 25, 25, 25)
RUNS_IN_A_TASK = 20_000  # of one gram; beyond, windows are dealt
WINDOWS_AT_ONCE = 1_000_000
_LOW = np.uint64(0xFFFFFFFF)
_POSTING = np.dtype([("gram", "<u4"), ("run", "<u8"), ("text", "<u4"), ("start", "<u4"), ("left", "u1"), ("more", "u1")])
_REQUEST = np.dtype([("gram", "<u8"), ("start", "<u4"), ("left", "u1"), ("more", "u1"), ("hot", "u1")])
_WINDOW = np.dtype([("window", "<u8"), ("uid", "<i8"), ("start", "<u4")])


def _every_byte() -> Words:
    return Words(np.arange(1, 257, dtype=np.uint16))


def runs_of(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text, first window, anchor minus first, last minus first, gram hash, hash of all its bytes)."""
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    if len(data) < WIDTH:
        return none
    sums = words.sums(words.codes[words.letters[data]])
    _, inverse = words.powers(len(sums))
    n = len(data) - GRAM + 1
    gram = mixed((sums[GRAM:] - sums[:n]) * inverse[:n])
    low = (gram & ~_LOW) | np.arange(n, dtype=np.uint64)
    grams = WIDTH - GRAM + 1
    size = 1
    while size * 2 <= grams:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = grams - size
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    starts = np.arange(len(data) - WIDTH + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(starts)]
    valid = starts + WIDTH <= offsets[1:][text]
    starts, text, anchor = starts[valid], text[valid], (low[: len(valid)][valid] & _LOW).astype(np.int64)
    if not len(starts):
        return none
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    last = starts[np.append(head[1:], len(starts)) - 1]
    first, anchor, text = starts[head], anchor[head], text[head]
    whole = words.window(sums, first, last + WIDTH)
    return text, first - offsets[text], anchor - first, last - first, gram[anchor], mixed(whole + (anchor - first).astype(np.uint64))


def _first_of_equal(run: np.ndarray, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Mask of the first (by owner, then start) of each group of equal runs."""
    turn = np.argsort(run, kind="stable")
    same = run[turn][1:] == run[turn][:-1]
    in_group = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    first = np.ones(len(run), bool)
    some = turn[in_group]
    if len(some):
        some = some[np.lexsort((start[some], owner[some], run[some]))]
        first[some[1:]] = run[some[1:]] != run[some[:-1]]
    return first


def _anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, held, size = _every_byte(), {}, [], 0

        def packed() -> pa.RecordBatch:
            uid, start, left, more, gram, whole = (np.concatenate([h[i] for h in held]) for i in range(6))
            first = _first_of_equal(whole, uid, start)
            uids, number = np.unique(uid, return_inverse=True)
            out = np.empty(len(uid), _POSTING)
            out["gram"], out["run"], out["text"], out["start"], out["left"], out["more"] = (gram & _LOW), whole, number, start, left, more
            bucket = ((gram >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            rows: list[list] = [[], [], [], []]
            for repeated in (False, True):
                at = np.flatnonzero(first != repeated)
                at = at[np.argsort(bucket[at], kind="stable")]
                b = bucket[at]
                cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else [0]
                for x, y in zip(cut[:-1], cut[1:]):
                    part = out[at[x:y]]
                    some, part["text"] = np.unique(part["text"], return_inverse=True)
                    rows[0].append(int(b[x]))
                    rows[1].append(repeated)
                    rows[2].append(uids[some].tobytes())
                    rows[3].append(part.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.bool_()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())],
                                              names=["bucket", "repeated", "uids", "postings"])

        for batch, data, offsets in text_groups(batches, "text", 1 << 19):
            uid = batch.column("uid").to_numpy()
            text, start, left, more, gram, whole = runs_of(data, offsets, words)
            skip = np.zeros(len(uid), bool)  # a later equal text of this task
            for i, u in enumerate(uid.tolist()):
                if offsets[i + 1] - offsets[i] >= WIDTH:
                    d = hashlib.md5(data[offsets[i] : offsets[i + 1]]).digest()
                    skip[i] = seen.setdefault(d, u) < u
                    seen[d] = min(seen[d], u)
            keep = ~skip[text]
            held.append((uid[text][keep], start[keep], left[keep], more[keep], gram[keep], whole[keep]))
            size += int(keep.sum())
            if size > 300_000:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    return run


def _shared(batches: Iterator[pa.RecordBatch], texts: int, most: int) -> Iterator[pa.RecordBatch]:
    """Spans that are repeats (start << 32 | end), and runs whose bytes are needed, packed by bucket of the text."""
    postings, owners, buckets = [], [], []
    done_uid, done_span = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def span(p):
        start = p["start"].astype(np.int64)
        return (start << 32) | (start + p["more"] + WIDTH)

    for batch in batches:
        for b, repeated, u, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "repeated", "uids", "postings"))):
            p, uids = np.frombuffer(blob, _POSTING), np.frombuffer(u, np.int64)
            if repeated:
                done_uid.append(uids[p["text"]])
                done_span.append(span(p))
            else:
                postings.append(p)
                owners.append(uids[p["text"]])
                buckets.append(np.full(len(p), b, np.uint64))
    ask_uid, ask = np.empty(0, np.int64), np.empty(0, _REQUEST)
    if postings:
        p, uid = np.concatenate(postings), np.concatenate(owners)
        gram = (np.concatenate(buckets) << np.uint64(32)) | p["gram"]
        first = _first_of_equal(p["run"], uid, p["start"])
        done_uid.append(uid[~first])
        done_span.append(span(p[~first]))
        p, uid, gram = p[first], uid[first], gram[first]
        turn = np.argsort(gram, kind="stable")
        g = gram[turn]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
        many = np.diff(np.append(head, len(g)))
        turn, many = turn[np.repeat(many > 1, many)], np.repeat(many, many)[np.repeat(many > 1, many)]
        p, ask_uid = p[turn], uid[turn]
        ask = np.empty(len(p), _REQUEST)
        ask["gram"], ask["start"], ask["left"], ask["more"] = gram[turn], p["start"], p["left"], p["more"]
        ask["hot"] = many > most
    done_uid, done_span = np.concatenate(done_uid), np.concatenate(done_span)
    rows: dict[int, list[bytes]] = {}
    for k, uid, values in ((0, done_uid, done_span), (1, ask_uid, ask)):
        bucket = (mixed(uid.view(np.uint64)) % np.uint64(texts)).astype(np.int64)
        turn = np.argsort(bucket, kind="stable")
        bucket, uid, values = bucket[turn], uid[turn], values[turn]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(uid) else [0]
        for x, y in zip(cut[:-1], cut[1:]):
            rows.setdefault(int(bucket[x]), [b"", b""])[k] = uid[x:y].tobytes() + values[x:y].tobytes()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *(pa.array([v[k] for v in rows.values()], pa.binary()) for k in (0, 1))],
                                         names=["bucket", "spans", "runs"])


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of the partition: its spans and its runs."""
    got: list[list] = [[], []]
    for batch in batches:
        for k, column, item in ((0, "spans", np.dtype("<i8")), (1, "runs", _REQUEST)):
            for blob in batch.column(column).to_pylist():
                n = len(blob) // (8 + item.itemsize)
                got[k].append((np.frombuffer(blob, np.int64, n), np.frombuffer(blob, item, n, 8 * n)))
    if not got[0]:
        return
    (span_uid, span), (run_uid, run) = ((np.concatenate([g[0] for g in x]), np.concatenate([g[1] for g in x])) for x in got)
    a, b = np.argsort(span_uid, kind="stable"), np.argsort(run_uid, kind="stable")
    span_uid, span, run_uid, run = span_uid[a], span[a], run_uid[b], run[b]
    uids = np.unique(np.concatenate([span_uid, run_uid]))
    x, y = (np.append(np.searchsorted(v, uids), len(v)) for v in (span_uid, run_uid))
    for at in range(0, len(uids), 8192):
        few = range(at, min(at + 8192, len(uids)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(uids[few.start : few.stop]), pa.array([span[x[i] : x[i + 1]].tobytes() for i in few], pa.binary()),
             pa.array([run[y[i] : y[i + 1]].tobytes() for i in few], pa.binary())], names=["uid", "spans", "runs"])


def _fetched(buckets: int):
    """The bytes of the runs asked for, packed by bucket of gram; of hot grams the windows, packed by bucket of their hash, and spans found already."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size, windows, many = _every_byte(), [], 0, [], 0

        def rows_of(bucket: list[int], **columns: list[bytes]) -> pa.RecordBatch:
            given = [pa.array(columns.get(name, [None] * len(bucket)), pa.binary()) for name in ("runs", "windows")]
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *given], names=["bucket", "runs", "windows"])

        def packed() -> pa.RecordBatch:
            uid, ask, body = (np.concatenate([h[i] for h in held]) for i in range(3))
            length = ask["more"].astype(np.int64) + WIDTH
            begin = np.cumsum(length) - length
            bucket = (mixed(ask["gram"]) % np.uint64(buckets)).astype(np.int32)
            row = np.argsort(bucket, kind="stable")
            bucket = bucket[row]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            blobs = []
            for x, y in zip(cut[:-1], cut[1:]):
                r = row[x:y]
                size_of = length[r]
                source = np.repeat(begin[r] - (np.cumsum(size_of) - size_of), size_of) + np.arange(size_of.sum())
                blobs.append(np.int64(y - x).tobytes() + uid[r].tobytes() + ask[r].tobytes() + body[source].tobytes())
            return rows_of(bucket[cut[:-1]].tolist(), runs=blobs)

        def dealt() -> Iterator[pa.RecordBatch]:
            w = np.concatenate(windows)
            first = _first_of_equal(w["window"], w["uid"], w["start"])
            if not first.all():
                uid, span = _joined(w["uid"][~first], w["start"][~first].astype(np.int64))
                yield rows_of([int(mixed(uid[:1].view(np.uint64))[0] % np.uint64(buckets))], windows=[b"S" + uid.tobytes() + span.tobytes()])
            w = w[first]
            bucket = (mixed(w["window"]) % np.uint64(buckets)).astype(np.int32)
            turn = np.argsort(bucket, kind="stable")
            bucket, w = bucket[turn], w[turn]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            yield rows_of(bucket[cut[:-1]].tolist(), windows=[b"W" + w[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])])

        for batch, data, offsets in text_groups(batches, "text", 1 << 20):
            asks = [np.frombuffer(a, _REQUEST) for a in batch.column("runs").to_pylist()]
            counts = [len(a) for a in asks]
            ask, uid, at = np.concatenate(asks), np.repeat(batch.column("uid").to_numpy(), counts), np.repeat(offsets[:-1], counts)
            hot = ask["hot"] > 0
            if hot.any():
                sums = words.sums(words.codes[words.letters[data]])
                some = np.flatnonzero(hot)
                for k in range(0, len(some), 10_000):
                    of = some[k : k + 10_000]
                    count = ask["more"][of].astype(np.int64) + 1
                    run, j = np.repeat(of, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    out = np.empty(len(run), _WINDOW)
                    out["uid"], out["start"] = uid[run], ask["start"][run] + j
                    place = (ask["left"][run].astype(np.int64) - j + WIDTH).astype(np.uint64)
                    key, begin = mixed(ask["gram"][run] * np.uint64(0xA0761D6478BD642F) + place), at[run] + out["start"]
                    out["window"] = mixed(key * np.uint64(0xD6E8FEB86659FD93) + words.window(sums, begin, begin + WIDTH))
                    windows.append(out)
                    many += len(out)
                    if many > WINDOWS_AT_ONCE:
                        yield from dealt()
                        windows, many = [], 0
                ask, uid, at = ask[~hot], uid[~hot], at[~hot]
            if len(ask):
                length = ask["more"].astype(np.int64) + WIDTH
                begin = at + ask["start"]
                source = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
                held.append((uid, ask, data[source]))
                size += len(source)
            if size > 8 << 20:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()
        if many:
            yield from dealt()

    return run


def _joined(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as (owner, span), those of an owner that touch as one."""
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + WIDTH)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], (start[first] << 32) | (start[last] + WIDTH)


def radix_groups(bodies: np.ndarray, begin: np.ndarray, group: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(window, group) of the windows that are not alone after all digits."""
    sums = words.sums(words.codes[words.letters[bodies]])
    at, depth = np.arange(len(begin)), 0
    for digit in (0, *DIGITS):
        key = group[at]
        if digit:
            s = begin[at] + depth
            key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + words.window(sums, s, s + digit))
            depth += digit
        turn = np.argsort(key, kind="stable")
        k = key[turn]
        same = k[1:] == k[:-1]
        keep = turn[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(k) else turn
        group[at] = key
        at = at[np.sort(keep)]
    return at, group[at]


def _sorted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of windows that are equal to an earlier one."""
    words, blobs, windows = _every_byte(), [], []
    for batch in batches:
        blobs += [b for b in batch.column("runs").to_pylist() if b]
        for blob in batch.column("windows").to_pylist():
            if blob and blob[:1] == b"W":
                windows.append(np.frombuffer(blob, _WINDOW, offset=1))
            elif blob:
                n = (len(blob) - 1) // 16
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob, np.int64, n, 1)), pa.array(np.frombuffer(blob, np.int64, n, 1 + 8 * n))], names=["uid", "span"])
    if windows:
        w = np.concatenate(windows)
        windows = None
        later = ~_first_of_equal(w["window"], w["uid"], w["start"])
        if later.any():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _joined(w["uid"][later], w["start"][later].astype(np.int64))], names=["uid", "span"])
        del w
    if not blobs:
        return
    uid, ask, body = [], [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        uid.append(np.frombuffer(blob, np.int64, n, 8))
        ask.append(np.frombuffer(blob, _REQUEST, n, 8 + 8 * n))
        body.append(np.frombuffer(blob, np.uint8, offset=8 + (8 + _REQUEST.itemsize) * n))
    del blobs
    uid, ask, body = (np.concatenate(x) for x in (uid, ask, body))
    length = ask["more"].astype(np.int64) + WIDTH
    begin = np.cumsum(length) - length
    # whole grams go together, so many at a time that the windows fit
    turn = np.argsort(ask["gram"], kind="stable")
    head = np.flatnonzero(np.concatenate([[True], ask["gram"][turn][1:] != ask["gram"][turn][:-1]]))
    ends = np.append(head[1:], len(turn))
    at = 0
    while at < len(head):
        to = max(at + 1, int(np.searchsorted(ends, head[at] + 10_000, "right")))
        r = turn[head[at] : ends[to - 1]]
        at = to
        windows = ask["more"][r].astype(np.int64) + 1
        run = np.repeat(r, windows)
        j = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
        place = ask["left"][run].astype(np.int64) - j + WIDTH  # of the gram in the window, never below 0
        size_of = length[r]
        local = np.repeat(begin[r] - (np.cumsum(size_of) - size_of), size_of) + np.arange(size_of.sum())
        new_begin = np.zeros(len(begin), np.int64)
        new_begin[r] = np.cumsum(size_of) - size_of
        group = mixed(ask["gram"][run] * np.uint64(0xA0761D6478BD642F) + place.astype(np.uint64))
        window, group = radix_groups(body[local], new_begin[run] + j, group, words)
        if not len(window):
            continue
        owner, start = uid[run[window]], ask["start"][run[window]].astype(np.int64) + j[window]
        order = np.lexsort((start, owner, group))
        group, owner, start = group[order], owner[order], start[order]
        later = np.concatenate([[False], group[1:] == group[:-1]])
        owner, start = owner[later], start[later]
        if len(owner):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _joined(owner, start)], names=["uid", "span"])


def _cut(carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"removed": [], "kept": []}
            spans_of = [batch.column(c).to_pylist() for c in ("known", "spans")]
            for text, copy, known, spans in zip(batch.column("text").to_pylist(), batch.column("copy").to_pylist(), *spans_of):
                data, merged = (text or "").encode(), []
                if copy:
                    merged = [[0, len(data)]] if data else []
                else:
                    packed = np.frombuffer(known or b"", np.int64)
                    if spans:
                        packed = np.concatenate([packed, np.array(spans, np.int64)])
                    for s in np.sort(packed).tolist():
                        a, b = s >> 32, s & 0xFFFFFFFF
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                at, kept = 0, []
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                out["removed"].append([{"start": a, "end": b} for a, b in merged])
                out["kept"].append(b"".join(kept))
            spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(out["removed"], spans_type), pa.array(out["kept"], pa.binary())],
                                             names=[*carried, "removed", "kept"])

    return run


def without_repeats(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (uid, text, ...) -> (uid, carried columns, removed, kept): the merged byte spans that repeat an earlier stretch of
    100 bytes, in order, and the bytes left (which may end inside a character)."""
    spark = docs.sparkSession
    rows = docs.select("uid", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (24 << 20)))
    anchors = rows.mapInArrow(_anchors(8 * partitions), "bucket int, repeated boolean, uids binary, postings binary")
    most = RUNS_IN_A_TASK
    shared = anchors.repartition(partitions, "bucket").mapInArrow(lambda batches: _shared(batches, 8 * partitions, most), "bucket int, spans binary, runs binary")
    found = cut_lineage(shared.repartition(partitions, "bucket").mapInArrow(_by_text, "uid long, spans binary, runs binary"))
    marks = docs.filter(F.octet_length("text") >= WIDTH).select("uid", F.md5(F.encode("text", "UTF-8")).alias("digest"))
    first = marks.groupBy("digest").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    copies = cut_lineage(marks.join(first, "digest").filter("uid <> first").select("uid"))
    touched = found.select("uid").union(copies)
    carried = list(dict.fromkeys(["uid", *carry]))
    some, others = bitmap_filter(docs.select(*dict.fromkeys([*carried, "text"])), "uid", touched, apart=True)
    runs = found.filter(F.octet_length("runs") > 0).join(copies, "uid", "left_anti").select("uid", "runs")
    bodies = some.join(runs, "uid").select("uid", "text", "runs").mapInArrow(_fetched(8 * partitions), "bucket int, runs binary, windows binary")
    late = bodies.repartition(partitions, "bucket").mapInArrow(_sorted_windows, "uid long, span long")
    late = cut_lineage(late)
    known = found.filter(F.octet_length("spans") > 0).select("uid", F.col("spans").alias("known"))
    spans = late.groupBy("uid").agg(F.collect_list("span").alias("spans"))
    joined = some.join(known, "uid", "left").join(spans, "uid", "left").join(copies.withColumn("copy", F.lit(True)), "uid", "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema.fields)
    cut = joined.select(*dict.fromkeys([*carried, "text"]), "known", "spans", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(
        _cut(carried), f"{schema}, removed array<struct<start:int,end:int>>, kept binary")
    plain = others.select(*carried, F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("removed"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("kept"))
    return cut.unionByName(plain)
