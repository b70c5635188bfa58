"""Sharding over fixed virtual slots, with DataFrame and SQL functions only.

Records hash into thousands of slots that never change. What changes is a small versioned map from
slot to shard: bytes are summed per slot, and rebalancing edits the map, moving as few slots as it
needs. A record's place inside its shard comes from per-slot counts (base of the slot) and a row
number inside the slot, so no task ever holds a shard.

Defined cases: a null or empty text has size 8 and CRC 0; a null doc_id hashes like any value;
repeated rows are numbered and spread over slots by their numbers; an empty table gives an empty
result and an unedited map; extra columns are not read. A store that holds versions is edited from its
latest one; the query begins with a store of its own, as its tables have nothing to do with one another.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, shared_dir, utf8_bytes

SLOTS = 4096
SHARDS = 24
#: Bytes that every record counts besides its text.
RECORD_BYTES = 8
#: Copies of one row that are written out at once.
COPY_LOT = 4096
#: Slots from a copy to the next: odd, so that all come in turn.
COPY_STEP = 1597
#: Largest difference between two shards, as a share of the mean, that rebalancing leaves alone.
TOLERANCE = 0.001


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: ``shards[slot]`` is the shard of a slot. It has ``SLOTS`` entries, whatever the data."""

    version: int
    shards: tuple[int, ...]

    @staticmethod
    def even(shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        """Version 0: equal numbers of slots for each shard."""
        return SlotMap(0, tuple(slot * shards // slots for slot in range(slots)))

    def rebalanced(self, slot_bytes: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> SlotMap:
        """The next version: slots move, or change places, from the fullest shard or to the emptiest while that helps."""
        owner = list(self.shards)
        held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
        for slot, shard in enumerate(owner):
            held[shard].append((slot_bytes.get(slot, 0), slot))
        for slots in held:
            slots.sort()
        loads = [sum(b for b, _ in slots) for slots in held]
        slack = tolerance * sum(loads) / shards
        def better(high: int, low: int) -> tuple[float, bool, tuple[int, int], tuple[int, int] | None] | None:
            """The move or exchange from ``high`` to ``low`` that comes nearest to half their difference."""
            gap, best = loads[high] - loads[low], None
            for give in held[high]:
                near = bisect_left(held[low], (give[0] - gap // 2, -1))
                for back in [None, *held[low][max(0, near - 1) : near + 1]]:
                    moved = give[0] - (back[0] if back else 0)
                    if 0 < moved < gap and (best is None or (abs(moved - gap / 2), back is not None) < best[:2]):
                        best = (abs(moved - gap / 2), back is not None, give, back)
            return best

        while max(loads) - min(loads) > slack:
            order = sorted(range(shards), key=lambda k: (loads[k], k))
            # The fullest gives to the emptiest that takes something of use; if none does, the emptiest takes from the others.
            ways = [(order[-1], low) for low in order[:-1]] + [(high, order[0]) for high in order[-2:0:-1]]
            found = next(((high, low, best) for high, low in ways if (best := better(high, low))), None)
            if found is None:
                break
            high, low, best = found
            for item, here, there in ((best[2], high, low), (best[3], low, high)):
                if item:
                    held[here].remove(item)
                    insort(held[there], item)
                    loads[here] -= item[0]
                    loads[there] += item[0]
                    owner[item[1]] = there
        return SlotMap(self.version + 1, tuple(owner))


class SlotMapStore:
    """Versions of a slot map as Parquet in the shared folder; a version is never overwritten."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        """``path`` is that of a store with versions; a new store gets a folder of its own."""
        self.spark = spark
        self.stored = path is not None
        self.path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"

    def put(self, slot_map: SlotMap, counts: dict[int, int] | None = None) -> None:
        """Store a version; with ``counts`` also the rows before each slot inside its shard."""
        base = dict.fromkeys(slot_map.shards, 0)
        rows = []
        for slot, shard in enumerate(slot_map.shards):
            rows.append((slot_map.version, slot, shard, base[shard]))
            base[shard] += (counts or {}).get(slot, 0)
        self.spark.createDataFrame(rows, "version int, slot int, shard int, base long").coalesce(1).write.mode("append").parquet(self.path)
        self.stored = True

    def latest(self) -> SlotMap | None:
        """The map of the highest version, None in an empty store."""
        if not self.stored:
            return None
        rows = self.spark.read.schema("version int, slot int, shard int, base long").parquet(self.path)
        version = rows.agg(F.max("version")).head()[0]
        return SlotMap(version, tuple(r["shard"] for r in rows.where(F.col("version") == version).orderBy("slot").collect()))

    def get(self, version: int) -> DataFrame:
        return self.spark.read.schema("version int, slot int, shard int, base long").parquet(self.path).where(F.col("version") == version).drop("version")


def virtual_slot(key: Column, crc: Column, copy: Column, slots: int = SLOTS) -> Column:
    """The slot of a record; copies of one go round all slots from there."""
    return F.pmod(F.pmod(F.xxhash64(key, crc), F.lit(slots)) + copy * COPY_STEP, F.lit(slots)).cast("int")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with copy, the number of a row among its equals. They are counted before the shuffle and written out again after it."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    lot = F.col("lot") * COPY_LOT
    lots = counted.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("copies") - 1) / COPY_LOT).cast("long"))))
    return lots.withColumn("copy", F.explode(F.sequence(lot, F.least(lot + (COPY_LOT - 1), F.col("copies") - 1)))).select(*rows.columns, "copy")


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, store: SlotMapStore | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (the place in the shard), virtual_slot and map_version of every row of ``docs``."""
    sized = docs.select(
        "doc_id",
        (utf8_bytes("text") + F.lit(RECORD_BYTES)).alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    sized = numbered(sized).withColumn("virtual_slot", virtual_slot(F.col("doc_id"), F.col("text_crc32"), F.col("copy"), slots))
    per_slot = sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    store = store or SlotMapStore(docs.sparkSession)
    slot_map = store.latest()
    if slot_map is None:
        slot_map = SlotMap.even(shards, slots)
        store.put(slot_map)
    slot_map = slot_map.rebalanced({r["virtual_slot"]: r["bytes"] for r in per_slot}, shards)
    store.put(slot_map, {r["virtual_slot"]: r["rows"] for r in per_slot})
    # The map has as many rows as there are slots, so it may always be broadcast.
    mapped = sized.join(F.broadcast(store.get(slot_map.version).withColumnRenamed("slot", "virtual_slot")), "virtual_slot")
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy"))
    return mapped.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + inside - 1).alias("slot"), "virtual_slot", F.lit(slot_map.version).alias("map_version")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )
