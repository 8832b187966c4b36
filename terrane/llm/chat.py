"""Chat formatting with cumulative-snapshot collapse.

Logs often keep every state of a growing conversation. Each conversation's turns get rolling
prefix hashes; a conversation whose whole is a proper prefix of another one's turns goes, and
of equal conversations the one with the least id stays. The rest is rendered. DataFrame
functions only.

A turn's prefix hash is the sum of its own and all earlier turns' hashes, each of which takes in
the turn's rank. All turns are laid out in ranges of (conversation, turn, role, text) and written
once with the number of their range, so a conversation of any size, turns with one number, and turns without
number that repeat, in pieces, are spread over tasks. Ranks, hashes and lengths are summed inside (range, conversation), and
the totals of the ranges before are added.

A conversation is one row, however many turns it has, unless its rendering exceeds
`max_bytes`; then it is cut into parts between turns, so that no row or task has to hold it all.

Defined cases: turns are ordered by number (nulls first, then from the least), then role, then
text. Rows that are equal in all of these are one turn that was logged repeatedly, and count once;
without a number they can't be told apart from turns that were said repeatedly, so they count as
often as they occur. Null roles are rendered as "unknown", null texts as empty; rows with null
conv_id form one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


@dataclass(frozen=True)
class Style:
    #: UTF-8 bytes of one part; a single turn is never cut.
    max_bytes: int = 64 << 20
    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"


#: Hashes are summed as decimals: 38 digits hold the exact sum of 10**19 of them.
_EXACT = "decimal(38,0)"
_ORDER = ("turn", "role", "text")


def laid_out(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, role, text, piece, n (how often the turn counts here), range: distinct turns, in pieces of PIECE repeats, each with the number of the range that holds it."""
    rows = turns.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    distinct = rows.groupBy("conv_id", *_ORDER).agg(F.count(F.lit(1)).alias("seen"))
    counted = distinct.select("conv_id", *_ORDER, F.when(F.col("turn").isNull(), F.col("seen")).otherwise(1).cast("long").alias("n"))
    pieces = _pieces(_pieces(counted.withColumn("piece", F.lit(0).cast("long")), 1 << 20), PIECE)
    # written with its number, so that every later step sees the same ranges
    return scratch.keep(pieces.repartitionByRange("conv_id", *_ORDER, "piece").withColumn("range", F.spark_partition_id()), "ranges")


#: Repeats of a turn that stand in one row; more are laid out over ranges like other turns.
PIECE = 64


def _pieces(rows: DataFrame, size: int) -> DataFrame:
    """Rows that stand for n repeats, cut into rows of up to size; piece: how many repeats stand before."""
    first = rows.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long"))))
    return first.withColumns({"piece": F.col("piece") + F.col("_at"), "n": F.least(F.col("n") - F.col("_at"), F.lit(size).cast("long"))}).drop("_at")


def _ahead(rows: DataFrame, **sums: Column) -> DataFrame:
    """conv_id, range, and the sums over the conversation's ranges before this one: as many rows as ranges touch conversations."""
    totals = rows.groupBy("conv_id", "range").agg(*(c.alias(k) for k, c in sums.items()))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("conv_id", "range", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_ahead") for k in sums))


def prefix_hashes(turns: DataFrame, style: Style, scratch: Scratch) -> DataFrame:
    """conv_id, range, rank (from 1), role, text, h (of the prefix up to the turn), part (from 0), for each turn."""
    rows = laid_out(turns, scratch)
    inside = Window.partitionBy("range", "conv_id")
    placed = rows.withColumn("last", F.sum("n").over(inside.orderBy(*_ORDER, "piece").rowsBetween(Window.unboundedPreceding, 0)))
    ahead = _ahead(rows, n=F.sum("n"))
    every = _join(placed, ahead, ["conv_id", "range"]).withColumn("rank", F.explode(F.sequence(F.col("last") - F.col("n") + 1, F.col("last")))).withColumn("rank", (F.col("rank") + F.col("n_ahead")).cast("long"))
    own = F.xxhash64("rank", "role", "text").cast(_EXACT)
    size = (F.octet_length("role") + F.octet_length("text") + len((style.start + style.end).encode()) + 1).cast("long")
    so_far = inside.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = every.select("conv_id", "range", "rank", "role", "text", own.alias("own"), size.alias("size"))
    summed = summed.withColumns({"h_in": F.sum("own").over(so_far), "size_in": F.sum("size").over(so_far)})
    summed = scratch.keep(summed, "summed")
    both = _join(summed, _ahead(summed, h=F.sum("own"), size=F.sum("size")), ["conv_id", "range"])
    before = F.col("size_in") + F.col("size_ahead") - F.col("size")
    return both.select("conv_id", "range", "rank", "role", "text", (F.col("h_in") + F.col("h_ahead")).cast(_EXACT).alias("h"), F.floor(before / style.max_bytes).cast("int").alias("part"))


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join that keeps a's keys."""
    x, y = a.alias("x"), b.alias("y")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    joined = x.join(y, on, how)
    return joined.select("x.*", *(F.col(f"y.{c}") for c in b.columns if c not in keys)) if how in ("inner", "left") else joined.select("x.*")


def maximal(prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, n_turns, n_parts: the conversations that no other continues, one of equal ones. prefixes: kept in a table."""
    totals = prefixes.groupBy("conv_id").agg(F.max(F.struct("rank", "h")).alias("x"), F.max("part").alias("part"))
    # kept, so that both sides of the join below are plain shuffles and a long conversation can be split
    totals = scratch.keep(totals.select("conv_id", F.col("x.rank").alias("rank"), F.col("x.h").alias("h"), (F.col("part") + 1).alias("n_parts")), "totals")
    one = totals.groupBy("rank", "h").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "n_parts")).alias("x")).select("rank", "h", "x.conv_id", "x.n_parts")
    proper = _join(prefixes.select("conv_id", "rank", "h"), totals.select("conv_id", F.col("rank").alias("n")), ["conv_id"]).where("rank < n").select("rank", "h").distinct()
    return one.join(proper, ["rank", "h"], "left_anti").select("conv_id", F.col("rank").alias("n_turns"), "n_parts")


def rendered(role: Column, text: Column, style: Style) -> Column:
    return F.concat(F.lit(style.start), role, F.lit("\n"), text, F.lit(style.end))


def format_chats(turns: DataFrame, style: Style = Style()) -> DataFrame:
    """conv_id, part (from 0), n_parts, n_turns (of the conversation), text, for each maximal conversation; its parts' texts in order are its rendering."""
    scratch = Scratch(turns.sparkSession, "chats")
    prefixes = scratch.keep(prefix_hashes(turns, style, scratch), "prefixes")
    kept = scratch.keep(maximal(prefixes, scratch), "maximal")
    rows = _join(prefixes.select("conv_id", "part", "rank", "role", "text"), kept, ["conv_id"])
    each = rows.groupBy("conv_id", "part", "n_parts", "n_turns").agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), rendered(F.col("role"), F.col("text"), style).alias("t")))).alias("turns"))
    return each.select("conv_id", "part", F.col("n_parts").cast("long").alias("n_parts"), "n_turns", F.array_join(F.transform("turns", lambda x: x.t), "").alias("text"))
