"""Conversation structure repair: the cheapest edits that make a conversation alternate, by cost dynamic programming and prefix-doubling path ranking.

A conversation is read as a walk through four states (nothing yet, after a system message, after a user's, after an assistant's). Each message is kept, given
another role or deleted, empty messages may be inserted anywhere, and the walk has to end with nothing or after an assistant. Costs are `KEEP` and its
companions below; messages at fault (blank, repeated, without an end) cost as stated there.

Rows are sorted once by conversation and turn and cut into blocks of at most 65,536 rows, so that one conversation may hold any share of all rows:
each block's least costs between all pairs of states are found apart, chained along the conversation (16 numbers a block), and with what follows known
every block ranks its own arcs. Ranking: the nodes are the optimal arcs; after round k a rank orders the first 2^k letters of the audit that begins with an arc, the
pointer leads to the node behind these letters, and the best arc of a node is the one of least rank; the next round joins rank and the rank behind the
pointer. The least path is read off through the doubled pointers. In one state a letter leads to one state only, so equal letters are equal paths.

Null conversation ids are one conversation. Null turns come first and leave no gaps. Null roles and texts are one space, so the text is blank. Rows of
one turn are ordered by role, then by the digest of the text; rows alike in all are repeats of each other. Roles are told apart by their first letter
(s, u, a); others can only be replaced or deleted. Very long texts pass a task one after another. Other columns are ignored. A conversation without rows has an empty audit
and zero counts. An empty table gives none."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.rows import small_batches
from tallyframe.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, UNENDED = 0, 3, 4, 3, 3
BLOCK_BITS = 16
#: Codes ranked together.
SLICE = 1 << 17
_FAR = 1 << 40
_SPACES = " \t\n\x0b\f\r"
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
#: What an inserted or replaced message leads to, by state, and the letters of edits in ASCII order.
_ONWARD = np.array([_USER, _USER, _ASSISTANT, _USER])
_LETTERS = "DIKR"
#: Cost of the end of a conversation by state: messages inserted until the last is an assistant's.
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code (initial + 4 * class) and state: state after keeping, cost of keeping, cost of another role. Classes: sound, without an end, to be deleted."""
    to, keep, other = np.zeros((12, 4), np.int64), np.full((12, 4), _FAR), np.full((12, 4), _FAR)
    for kind in range(2):
        extra = UNENDED * kind
        other[4 * kind : 4 * kind + 4] = REROLE + extra
        for initial, states, onward in ((0, [_NONE], _SYSTEM), (1, [_NONE, _SYSTEM, _ASSISTANT], _USER), (2, [_USER], _ASSISTANT)):
            to[4 * kind + initial, states], keep[4 * kind + initial, states] = onward, KEEP + extra
    return to, keep, other


_KEPT_TO, _KEEP_COST, _OTHER_COST = _tables()


def _with_inserts(costs: np.ndarray) -> np.ndarray:
    """Least costs (last axis: state) when messages may be inserted first."""
    a, b = costs[..., _USER], costs[..., _ASSISTANT]
    user, assistant = np.minimum(a, b + INSERT), np.minimum(b, a + INSERT)
    none, system = (np.minimum(costs[..., s], user + INSERT) for s in (_NONE, _SYSTEM))
    return np.stack([none, system, user, assistant], -1)


def _before(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs from each state before a message, given those after it; first axis: messages, last axis: state."""
    shape = (len(codes),) + (1,) * (after.ndim - 2) + (4,)
    kept = _KEEP_COST[codes].reshape(shape) + np.take_along_axis(after, np.broadcast_to(_KEPT_TO[codes].reshape(shape), after.shape), -1)
    other = _OTHER_COST[codes].reshape(shape) + after[..., _ONWARD]
    return np.minimum(_with_inserts(np.minimum(np.minimum(kept, other), after + DELETE)), _FAR)


def _backward(codes: np.ndarray, offsets: np.ndarray, after: np.ndarray, keep_all: bool) -> np.ndarray:
    """Costs before the first message of each block, or (keep_all) before every message and behind the last one, block after block."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    sizes, now = -n[order], after[order].copy()
    ends = offsets[1:][order]
    if keep_all:
        places = offsets[1:] + np.arange(len(n))  # one place more a block
        out = np.empty((offsets[-1] + len(n), *after.shape[1:]), np.int64)
        out[places] = after
    for j in range(int(n.max(initial=0))):
        m = int(np.searchsorted(sizes, -j, "left"))  # blocks of more than j messages
        now[:m] = _before(codes[ends[:m] - 1 - j], now[:m])
        if keep_all:
            out[places[order[:m]] - 1 - j] = now[:m]
    if keep_all:
        return out
    first = np.empty_like(now)
    first[order] = now
    return first


def _ranked_paths(codes: np.ndarray, offsets: np.ndarray, after: np.ndarray, starts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(least audit, state at the end) from each start, a pair (block, state)."""
    n = np.diff(offsets)
    costs = _backward(codes, offsets, after, True)
    blocks = np.repeat(np.arange(len(n)), n + 1)
    first = offsets[:-1] + np.arange(len(n))
    last = np.zeros(len(costs), bool)
    last[first + n] = True
    code = np.zeros(len(costs), np.int64)
    code[~last] = codes
    nodes = np.arange(len(costs) * 4).reshape(-1, 4)
    below = np.minimum(np.arange(1, len(costs) + 1), len(costs) - 1)
    # Arcs in the order of their letters: delete, insert, keep, other role.
    target = np.stack([nodes[below], nodes[:, _ONWARD], nodes[below[:, None], _KEPT_TO[code]], nodes[below[:, None], _ONWARD[None, :]]], -1)
    behind = costs.reshape(-1)[target]
    price = np.stack([np.full_like(costs, DELETE), np.full_like(costs, INSERT), _KEEP_COST[code], _OTHER_COST[code]], -1)
    optimal = (price + behind == costs[..., None]) & (costs[..., None] < _FAR) & ~last[:, None, None]
    unused = 1 << 40
    rank = np.where(optimal, np.arange(1, 5), unused).reshape(-1, 4)
    reach = target.reshape(-1, 4)
    stuck = ~optimal.reshape(-1, 4).any(1)  # ends, and nodes from which nothing leads on
    rank[stuck], reach[stuck] = [0, unused, unused, unused], np.flatnonzero(stuck)[:, None]
    own = np.arange(len(rank))
    pointers = []
    while True:
        best = rank.argmin(1)
        pointers.append(reach[own, best].astype(np.int32))
        if stuck[pointers[-1]].all():
            break
        least = rank[own, best]
        joined = np.where(rank < unused, rank * (int(least.max()) + 1) + least[reach], -1)
        values, place = np.unique(joined, return_inverse=True)
        rank = np.where(joined < 0, unused, place.reshape(rank.shape) - (1 if values[0] < 0 else 0))
        reach = pointers[-1][reach].astype(np.int64)
    letter = np.frombuffer(_LETTERS.encode(), np.uint8)[best]
    audits, states = [], []
    for b, s in starts:
        path = np.array([(first[b]) * 4 + s])
        for step in reversed(pointers):
            path = np.stack([path, step[path]], 1).reshape(-1)
            ended = stuck[path]
            if ended.any():
                path = path[: int(ended.argmax()) + 1]  # all behind the end is the end again
        end = path[-1] if stuck[path[-1]] else pointers[0][path[-1]]
        audits.append(letter[path[~stuck[path]]].tobytes().decode())
        states.append(int(end) % 4)
    assert all(blocks[p // 4] == b for p, (b, _) in zip([first[b] * 4 for b, _ in starts], starts))
    return audits, np.array(states, np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with about SLICE codes: (rows, codes end to end, offsets)."""
    for batch in batches:
        codes = batch.column("codes").to_pylist()
        lengths = np.array([len(c) for c in codes], np.int64)
        at = 0
        while at < len(codes):
            to = max(at + 1, at + int(np.searchsorted(np.cumsum(lengths[at:]), SLICE, "right")))
            joined = np.frombuffer("".join(codes[at:to]).encode(), np.uint8).astype(np.int64) - 65
            yield batch.slice(at, to - at), joined, np.concatenate([[0], np.cumsum(lengths[at:to])])
            at = to


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's least costs between states, and how many neighbours do not alternate."""
    unit = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for rows, codes, offsets in _slices(batches):
        found = _backward(codes, offsets, np.broadcast_to(unit, (rows.num_rows, 4, 4)).copy(), False).transpose(0, 2, 1)  # from, to
        initial = codes % 4
        pair = initial[:-1] * 4 + initial[1:]
        wrong = np.concatenate([[0], np.cumsum(~np.isin(pair, (1, 6, 9)))])
        bad = wrong[offsets[1:] - 1] - wrong[offsets[:-1]]
        keep = [rows.column(c) for c in rows.schema.names if c != "codes"]
        costs = pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * rows.num_rows + 1, 16), pa.int32()), pa.array(found.reshape(-1)))
        more = [costs, pa.array(bad), pa.array(initial[offsets[:-1]]), pa.array(initial[offsets[1:] - 1])]
        yield pa.RecordBatch.from_arrays([*keep, *more], names=[*(c for c in rows.schema.names if c != "codes"), "costs", "bad", "first_initial", "last_initial"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: costs behind it and the states in which the least paths enter it; the first block's row also has the conversation's numbers."""
    for batch in batches:
        out: list[dict] = []
        for key, blocks in zip(batch.column("key").to_pylist(), batch.column("blocks").to_pylist()):
            costs = [np.array(b["costs"], np.int64).reshape(4, 4) for b in blocks]
            after = [_END]
            for c in reversed(costs):
                after.append((c + after[-1]).min(1))
            after.reverse()
            total = int(after[0][_NONE])
            came = np.array([0, _FAR, _FAR, _FAR], np.int64)
            turns, illegal, last = 0, 0, None
            low = high = None
            for k, (b, c) in enumerate(zip(blocks, costs)):
                out.append({"key": key, "block": b["block"], "after": np.minimum(after[k + 1], _FAR).tolist(), "enters": np.flatnonzero(came + after[k] == total).tolist()})
                came = np.minimum((came[:, None] + c).min(0), _FAR)
                illegal += b["bad"] + (last is not None and (last, b["first_initial"]) not in ((0, 1), (1, 2), (2, 1)))
                last = b["last_initial"]
                turns += b["turns"] - (b["low"] is not None and b["low"] == high)
                low = b["low"] if low is None else low
                high = b["high"] if b["high"] is not None else high
            sums = {c: sum(b[c] for b in blocks) for c in ("blank", "duplicate", "truncated")}
            out[-len(blocks)] |= {"gaps": 0 if low is None else high - low + 1 - turns, **sums, "illegal": illegal, "cost": total}
        yield pa.RecordBatch.from_pylist(out, schema=_CHAIN)


_STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_CHAIN = pa.schema([("key", pa.string()), ("block", pa.int64()), ("after", pa.list_(pa.int64())), ("enters", pa.list_(pa.int64())), *[(c, pa.int64()) for c in _STATS]])
_CHAIN_SQL = "key string, block long, after array<long>, enters array<long>, " + ", ".join(f"{c} long" for c in _STATS)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's least audit from every state in which it may be entered."""
    for rows, codes, offsets in _slices(batches):
        enters = rows.column("enters").to_pylist()
        starts = np.array([(b, s) for b, own in enumerate(enters) for s in own], np.int64).reshape(-1, 2)
        audits, ends = _ranked_paths(codes, offsets, np.array(rows.column("after").to_pylist(), np.int64).reshape(-1, 4), starts)
        options: list[list[dict]] = [[] for _ in enters]
        for (b, s), audit, end in zip(starts.tolist(), audits, ends.tolist()):
            options[b].append({"enter": s, "leave": end, "audit": audit})
        yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("uid"), pa.array(options, _OPTIONS)], names=["key", "uid", "options"])


_OPTIONS = pa.list_(pa.struct([("enter", pa.int64()), ("leave", pa.int64()), ("audit", pa.string())]))


def _initial(role: Column) -> Column:
    return F.when(role.startswith("s"), 0).when(role.startswith("u"), 1).when(role.startswith("a"), 2).otherwise(3)


def in_order(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) sorted by conversation and turn, as a stage: uid is the place in that order."""
    small_batches(rows.sparkSession)
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    own = rows.select("conv_id", key.alias("key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    own = own.withColumn("digest", F.md5(F.col("text").cast("binary"))).withColumn("_tie", F.monotonically_increasing_id())  # rows alike in all are no single task
    ordered = own.orderBy("key", F.col("turn").asc_nulls_first(), "role", "digest", "_tie").drop("_tie")
    end = F.right(F.rtrim("text", F.lit(_SPACES)), F.lit(1))
    return cut_lineage(ordered.select(F.monotonically_increasing_id().alias("uid"), "*", _initial(F.col("role")).alias("initial"), (end == "").alias("blank"), (~end.isin("", ".", "!", "?")).alias("unended")))


def planned(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From `in_order`: (key and the conversation's numbers, pieces of audits (key, uid of their first row, options))."""
    said = ordered.groupBy("key", "role", "digest").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    narrow = ordered.select("key", "uid", "turn", "role", "digest", "initial", "blank", "unended")
    known = narrow.join(said, ["key", "role", "digest"], "left")
    again = ~F.col("blank") & F.coalesce(F.col("uid") > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("unended"), "truncated")
    kind = F.when(fault == "truncated", 1).when(fault.isNotNull(), 2).otherwise(0)
    rows = known.select("key", "uid", "turn", fault.alias("fault"), F.chr((F.col("initial") + 4 * kind + 65).cast("long")).alias("code"))
    place = F.shiftright("uid", BLOCK_BITS).alias("block")
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uid", "code"))), lambda x: x["code"]), "")  # at most 65,536
    counts = [F.count_if(F.col("fault") == c).alias(c) for c in ("blank", "duplicate", "truncated")]
    blocks = cut_lineage(rows.groupBy("key", place).agg(
        F.min("uid").alias("uid"), codes.alias("codes"), F.min("turn").cast("long").alias("low"), F.max("turn").cast("long").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns"), *counts))
    small = ["key", "block", "low", "high", "turns", "blank", "duplicate", "truncated"]
    schema = ", ".join(f"{c} {'string' if c == 'key' else 'long'}" for c in small) + ", costs array<long>, bad long, first_initial long, last_initial long"
    costs = blocks.select(*small, "codes").mapInArrow(_transfers, schema)
    together = costs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*costs.columns[1:]))).alias("blocks"))  # a row for 65,536 messages
    chain = cut_lineage(together.mapInArrow(_chained, _CHAIN_SQL))
    asked = blocks.select("key", "block", "uid", "codes").join(chain.select("key", "block", "after", "enters"), ["key", "block"])
    pieces = asked.mapInArrow(_pieces, "key string, uid long, options array<struct<enter: long, leave: long, audit: string>>")
    return chain.filter("cost is not null").select("key", *_STATS), pieces


def _walk(batches: Iterator[pa.RecordBatch], end_only: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and place, a block's options before its messages. Gives messages with their edits, or one row a conversation."""
    key, state, letters, at, audit, digest, some, place = None, _NONE, "", 0, [], hashlib.sha256(), False, 0
    roles = {_USER: "user", _ASSISTANT: "assistant"}
    names = ["key", "audit", "repaired_sha256"] if end_only else ["key", "place", "edit", "uid", "role", "text"]
    schema = pa.schema([(c, pa.int64() if c in ("place", "uid") else pa.string()) for c in names])
    out: list[dict] = []

    def put(edit: str, role: str | None = None, text: str | None = None, uid: int | None = None) -> None:
        nonlocal some, place
        if not end_only:
            out.append({"key": key, "place": place, "edit": edit, "uid": uid, "role": role, "text": text})
            place += 1
        elif role is not None:
            digest.update((("\n" if some else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            some = True

    def inserted() -> None:
        nonlocal state, at
        while at < len(letters) and letters[at] == "I":
            state, at = int(_ONWARD[state]), at + 1
            put("I", roles[state], "")

    def closed() -> None:
        nonlocal state
        inserted()
        while _END[state]:
            state = int(_ONWARD[state])
            audit.append("I")
            put("I", roles[state], "")
        if end_only:
            out.append({"key": key, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()})

    for batch in batches:
        for k, uid, role, text, options in zip(*(batch.column(c).to_pylist() for c in ("key", "uid", "role", "text", "options"))):
            if k != key:
                if key is not None:
                    closed()
                key, state, letters, at, audit, digest, some, place = k, _NONE, "", 0, [], hashlib.sha256(), False, 0
            if options is not None:
                inserted()
                letters, at = next(o["audit"] for o in options if o["enter"] == state), 0
                audit.append(letters)
                continue
            inserted()
            edit, at = letters[at], at + 1
            if edit == "D":
                put("D", uid=uid)
                continue
            state = int(_ONWARD[state]) if edit == "R" else {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}[role[0]]
            put(edit, role if edit == "K" else roles[state], text, uid)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
        out.clear()
    if key is not None:
        closed()
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _texts_and_pieces(ordered: DataFrame, pieces: DataFrame) -> DataFrame:
    none = F.lit(None)
    texts = ordered.select("key", "uid", F.lit(1).alias("kind"), "role", "text", none.cast(pieces.schema["options"].dataType).alias("options"))
    both = texts.unionByName(pieces.select("key", "uid", F.lit(0).alias("kind"), none.cast("string").alias("role"), none.cast("string").alias("text"), "options"))
    return both.repartition("key").sortWithinPartitions("key", "uid", "kind").drop("kind")


def repaired_messages(ordered: DataFrame, pieces: DataFrame) -> DataFrame:
    """(key, place, edit, uid, role, text): every edit in order; a deleted message has neither role nor text, an inserted one no uid."""
    return _texts_and_pieces(ordered, pieces).mapInArrow(lambda b: _walk(b, False), "key string, place long, edit string, uid long, role string, text string")


def audits(ordered: DataFrame, pieces: DataFrame) -> DataFrame:
    """(key, audit, repaired_sha256): a conversation's letters and the digest of its repaired messages pass one task as a stream, for a digest goes in order."""
    return _texts_and_pieces(ordered, pieces).mapInArrow(lambda b: _walk(b, True), "key string, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    ordered = in_order(rows)
    numbers, pieces = planned(ordered)
    ids = ordered.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    return ids.join(numbers, "key").join(audits(ordered, pieces), "key").drop("key")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations damaged by the remainder of a checksum of their place: dropped, emptied, without sentence ends, repeated, or with the role user."""
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    own = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(place.cast("binary")) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.filter("_d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_n")).drop("_n")
