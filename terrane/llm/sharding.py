"""Sharding by fixed virtual slots.

A record's hash puts it into one of thousands of slots, for good. Bytes are summed per slot,
and a versioned map says which shard holds each slot. A first map deals slots by size, largest
first, to the least loaded shard; a rebalance edits the last map and moves as few slots as it
can. Only slot totals (their number is fixed) reach the driver.

Defined cases: null text has no bytes; null ids and repeated rows hash like any value; an
empty table gives an empty result; other columns are ignored. Records that agree in id and
text share a slot, as they can't be told apart.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, text_bytes

#: Number of virtual slots; never changes once data is laid out.
SLOTS = 8192
RECORD_OVERHEAD = 16


def slot_of(slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(slots)).cast("int")


def record_size() -> Column:
    return text_bytes(F.col("text")) + RECORD_OVERHEAD


def slot_totals(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """slot, bytes, n_rows: at most `slots` rows."""
    return docs.select(slot_of(slots).alias("slot"), record_size().alias("size")).groupBy("slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot. Every slot has a shard, also those without records."""

    version: int
    n_shards: int
    shard: tuple[int, ...]
    moved: tuple[int, ...] = field(default=())

    @classmethod
    def deal(cls, sizes: dict[int, int], n_shards: int, slots: int = SLOTS) -> SlotMap:
        """A first map: slots by falling size, each to the shard with the least so far."""
        heap, shard = [(0, 0, s) for s in range(n_shards)], [0] * slots
        for slot in sorted(range(slots), key=lambda k: (-sizes.get(k, 0), k)):
            load, held, least = heapq.heappop(heap)
            shard[slot] = least
            heapq.heappush(heap, (load + sizes.get(slot, 0), held + 1, least))
        return cls(1, n_shards, tuple(shard))

    def loads(self, sizes: dict[int, int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shard):
            out[shard] += sizes.get(slot, 0)
        return out

    def rebalance(self, sizes: dict[int, int], n_shards: int | None = None, tolerance: float = 0.05) -> SlotMap:
        """The next version: slots leave shards that are over the mean by more than tolerance (or no longer exist) for the least loaded ones, while that helps."""
        n = n_shards or self.n_shards
        shard, moved = list(self.shard), []
        loads, held = [0] * max(n, self.n_shards), {}
        for slot, s in enumerate(shard):
            loads[s] += sizes.get(slot, 0)
            held.setdefault(s, []).append(slot)
        for s in held:
            held[s].sort(key=lambda k: (sizes.get(k, 0), k))

        def move(slot: int, to: int) -> None:
            loads[shard[slot]] -= sizes.get(slot, 0)
            loads[to] += sizes.get(slot, 0)
            shard[slot] = to
            moved.append(slot)

        for s in range(n, self.n_shards):
            for slot in reversed(held.get(s, [])):
                move(slot, min(range(n), key=lambda k: (loads[k], k)))
        mean = sum(loads) / n
        for _ in range(len(shard)):
            most, least = max(range(n), key=lambda k: (loads[k], -k)), min(range(n), key=lambda k: (loads[k], k))
            gap = loads[most] - loads[least]
            if loads[most] <= mean * (1 + tolerance) and loads[least] >= mean * (1 - tolerance):
                break
            fits = [k for k in held.get(most, []) if shard[k] == most and 0 < sizes.get(k, 0) < gap]
            if not fits:
                break
            slot = min(fits, key=lambda k: (abs(2 * sizes.get(k, 0) - gap), k))
            move(slot, least)
            held.setdefault(least, []).append(slot)
        return SlotMap(self.version + 1, n, tuple(shard), tuple(moved))

    def frame(self, spark: SparkSession) -> DataFrame:
        """version, slot, shard."""
        return spark.createDataFrame([(self.version, k, s) for k, s in enumerate(self.shard)], "version int, slot int, shard int").coalesce(1)


class SlotMapStore:
    """Versions of a map, one folder each; a version is never rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, m: SlotMap) -> None:
        m.frame(self.spark).withColumn("n_shards", F.lit(m.n_shards)).write.mode("error").parquet(f"{self.path}/version={m.version:06d}")

    def load(self, version: int) -> SlotMap:
        rows = self.spark.read.parquet(f"{self.path}/version={version:06d}").orderBy("slot").collect()
        return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def totals(docs: DataFrame, slots: int = SLOTS) -> tuple[dict[int, int], dict[int, int]]:
    """Bytes and rows of each slot that has records, on the driver: at most `slots` numbers each."""
    rows = slot_totals(docs, slots).collect()
    return {r["slot"]: r["bytes"] for r in rows}, {r["slot"]: r["n_rows"] for r in rows}


def place(docs: DataFrame, m: SlotMap, counts: dict[int, int], keep: list[str], slots: int = SLOTS) -> DataFrame:
    """Columns `keep` (expressions are evaluated before), size, text_crc32, v_slot, shard, and place: the row's number in its shard, from 0.

    A shard's rows are numbered slot by slot, so no task sorts a whole shard.
    """
    ahead, first = [0] * m.n_shards, []
    for slot, shard in enumerate(m.shard):
        first.append((slot, shard, ahead[shard]))
        ahead[shard] += counts.get(slot, 0)
    where = docs.sparkSession.createDataFrame(first, "v_slot int, shard int, ahead long").coalesce(1)
    rows = docs.select(*keep, record_size().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), slot_of(slots).alias("v_slot"))
    # the map has `slots` rows, whatever the input
    return rows.join(F.broadcast(where), "v_slot")


def assign(docs: DataFrame, n_shards: int = 40, slots: int = SLOTS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (the row's place in its shard), grown_shard, v_slot (its virtual slot)."""
    from pyspark.sql import Window

    spark = docs.sparkSession
    sizes, counts = totals(docs, slots)
    store = SlotMapStore(spark, Scratch(spark, "slot-map").path("map"))
    store.save(SlotMap.deal(sizes, n_shards, slots))
    rows = place(docs, store.load(1), counts, ["doc_id"], slots)
    number = F.row_number().over(Window.partitionBy("v_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("n", number).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("n")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "v_slot"
    )
