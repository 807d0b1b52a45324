"""Chat formatting by linking quotations.

A message's lines are parsed into its own lines and quoted ones with their level (the `>` marks before them). Normalised lines (lower case,
single spaces) are hashed. A quoted line is linked to the latest earlier own line of the same conversation with its hash; where
there is none, to the first message of the whole table that has it. A message replies to the earlier message of its conversation that most of its
outermost linked lines come from (the latest of equals), and so conversations become trees: root, depth and turn give their order.
The text returned has no quoted lines and no line that announces a quotation.

Each quoted line meets one earlier line only, by a window in turn order, so a line that everyone writes costs no pairs. Null texts have no lines;
rows without conversation or turn are returned with no link. Rows of one conversation and turn are one message to replies, but each is returned."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.rows import small_batches
from tallyframe.session import cut_lineage

_MARKS = re.compile(r"^((?:\s?>)+) ?")
_ANNOUNCES = re.compile(r"^(On|Le|Am|El) .{0,200}:\s*$")
_LINES = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64())]))


def parsed(text: str | None) -> tuple[str | None, list[tuple[int, str]]]:
    """(own text, [(level, normalised line)]); level 0 for own lines, empty lines left out."""
    if text is None:
        return None, []
    own, lines = [], []
    rows = text.split("\n")
    for k, row in enumerate(rows):
        marks = _MARKS.match(row)
        level = marks.group(1).count(">") if marks else 0
        if not level and _ANNOUNCES.match(row) and k + 1 < len(rows) and _MARKS.match(rows[k + 1]):
            continue
        body = row[marks.end() :] if marks else row
        if not level:
            own.append(row)
        if plain := " ".join(body.lower().split()):
            lines.append((level, plain))
    return "\n".join(own).strip("\n") if len(own) < len(rows) else text, lines


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, lines = [], []
        for text in batch.column("text").to_pylist():
            mine, found = parsed(text)
            own.append(mine)
            lines.append([{"level": n, "hash": int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)} for n, x in found])
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "turn", "role")], pa.array(own, pa.string()), pa.array(lines, _LINES)],
                                         names=["conv_id", "turn", "role", "text", "lines"])


def linked(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) -> (conv_id, turn, role, text, n_quoted, n_linked, reply_turn, source_conv, source_turn, root_turn, depth)."""
    small_batches(messages.sparkSession)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = cut_lineage(rows.mapInArrow(_hashed, "conv_id long, turn long, role string, text string, lines array<struct<level:int,hash:long>>"))
    known = rows.filter("conv_id is not null and turn is not null")
    lines = known.select("conv_id", "turn", F.explode("lines").alias("l")).select("conv_id", "turn", "l.level", "l.hash").distinct()
    own = F.when(F.col("level") == 0, F.col("turn"))
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    quoted = cut_lineage(lines.withColumn("from_turn", F.max(own).over(before)).filter("level > 0"))
    tally = quoted.filter("from_turn is not null").groupBy("conv_id", "turn", "level", "from_turn").agg(F.count(F.lit(1)).alias("n"))
    best = tally.groupBy("conv_id", "turn").agg(F.min(F.struct(F.col("level"), -F.col("n"), -F.col("from_turn"))).alias("b"), F.sum("n").alias("n_linked"))
    best = best.select("conv_id", "turn", (-F.col("b")["col3"]).alias("reply_turn"), "n_linked")
    first = lines.filter("level = 0").groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("at"))
    strange = quoted.filter("from_turn is null").join(first, "hash").filter(F.col("at")["conv_id"] != F.col("conv_id"))
    strange = strange.groupBy("conv_id", "turn").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n_strange"))
    counts = quoted.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quoted"))
    facts = counts.join(best, ["conv_id", "turn"], "left").join(strange, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "n_quoted", "reply_turn", (F.coalesce("n_linked", F.lit(0)) + F.coalesce("n_strange", F.lit(0))).alias("n_linked"),
        F.col("at")["conv_id"].alias("source_conv"), F.col("at")["turn"].alias("source_turn"))
    facts = cut_lineage(facts)
    ways = facts.filter("reply_turn is not null").select("conv_id", "turn", F.col("reply_turn").alias("up"), F.lit(1).cast("long").alias("depth"))
    ways = cut_lineage(ways)
    while True:  # pointers double: as many rounds as the logarithm of the longest chain of replies
        onward = ways.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        longer = cut_lineage(ways.join(onward, ["conv_id", "up"], "left"))
        if longer.filter("further is not null").isEmpty():
            break
        ways = cut_lineage(longer.select("conv_id", "turn", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    out = rows.drop("lines").join(facts, ["conv_id", "turn"], "left").join(ways.withColumnRenamed("up", "root_turn"), ["conv_id", "turn"], "left")
    none = F.lit(0).cast("long")
    return out.select("conv_id", "turn", "role", "text", F.coalesce("n_quoted", none).alias("n_quoted"), F.coalesce("n_linked", none).alias("n_linked"), "reply_turn", "source_conv",
                      "source_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", none).alias("depth"))


def as_mail(messages: DataFrame) -> DataFrame:
    """Each message as a reply by mail: the message of the turn before it in its conversation, quoted, then its own text. Of several messages of one
    turn the smallest text is quoted."""
    before = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("before")).select("conv_id", (F.col("turn") + 1).alias("turn"), "before")
    quoted = F.concat(F.lit("> "), F.replace(F.col("before"), F.lit("\n"), F.lit("\n> ")), F.lit("\n"))
    return messages.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.concat(F.coalesce(quoted, F.lit("")), F.col("text")).alias("text"))
