"""Sharding through a fixed number of virtual slots.

Records hash into ``VIRTUAL_SLOTS`` slots, whose number never changes; what changes is the slot map, a small
versioned table from slot to shard. Bytes are aggregated by slot (at most ``VIRTUAL_SLOTS`` rows, whatever the
input), and slots go to shards largest first, each to the lightest shard, so shards are near equal in bytes.
Maps are stored, a file for each version, under the folder that a query names. Adding shards edits the map: only slots that move into the new shards change. 10,080 has the divisors 1 to 10,
12, 14, 15, 16, 18, 20, 21, 24, 28, 30, 32 and so on, so that at large sizes, where slots are all alike, the
usual shard counts divide it evenly.

A row's place in its shard is the start of its slot there plus its rank in the slot; ranks are taken inside
each slot, never over a whole shard in one task.

Defined results: a null text has no bytes and CRC 0, so size 8. A null id is an id like any other. Rows with
equal id and text fall into the same slot and get different places. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.staging import staged

VIRTUAL_SLOTS = 10_080


@dataclass(frozen=True)
class SlotMap:
    """shard_of[v] is the shard of virtual slot v."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    def rows(self) -> list[tuple[int, int, int]]:
        return [(self.version, v, s) for v, s in enumerate(self.shard_of)]

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the map's table; a version that is there already is an error."""
        rows = spark.createDataFrame([(v, s) for _, v, s in self.rows()], "virtual_slot int, shard int")
        rows.coalesce(1).write.mode("error").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the latest."""
        table = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        shards = [r.shard for r in table.filter(F.col("version") == version).orderBy("virtual_slot").collect()]
        return SlotMap(version, max(shards) + 1, tuple(shards))


def balanced(slot_bytes: dict[int, int], n_shards: int, slots: int = VIRTUAL_SLOTS) -> SlotMap:
    """Largest slot first, to the shard with the fewest bytes, then the fewest slots."""
    heap = [(0, 0, s) for s in range(n_shards)]
    shard_of = [0] * slots
    for v in sorted(range(slots), key=lambda v: (-slot_bytes.get(v, 0), v)):
        size, count, s = heapq.heappop(heap)
        shard_of[v] = s
        heapq.heappush(heap, (size + slot_bytes.get(v, 0), count + 1, s))
    return SlotMap(1, n_shards, tuple(shard_of))


def rebalanced(old: SlotMap, slot_bytes: dict[int, int], n_shards: int) -> SlotMap:
    """Grow to ``n_shards``: slots leave the heaviest old shards for the new ones, and none moves otherwise."""
    if n_shards < old.n_shards:
        raise ValueError("a slot map only grows")
    shard_of = list(old.shard_of)
    goal = sum(slot_bytes.values()) / n_shards
    load = [0] * n_shards
    own: list[list[int]] = [[] for _ in range(n_shards)]
    for v in sorted(range(len(shard_of)), key=lambda v: (slot_bytes.get(v, 0), v)):
        load[shard_of[v]] += slot_bytes.get(v, 0)
        own[shard_of[v]].append(v)
    for new in range(old.n_shards, n_shards):
        givers = [(-load[s], s) for s in range(old.n_shards)]
        heapq.heapify(givers)
        while givers and load[new] < goal:
            s = heapq.heappop(givers)[1]
            room = goal - load[new]
            v = next((v for v in reversed(own[s]) if slot_bytes.get(v, 0) <= room and load[s] - slot_bytes.get(v, 0) > 0), None)
            if v is None:
                continue
            own[s].remove(v)
            shard_of[v] = new
            load[s] -= slot_bytes.get(v, 0)
            load[new] += slot_bytes.get(v, 0)
            if load[s] > goal:
                heapq.heappush(givers, (-load[s], s))
    return SlotMap(old.version + 1, n_shards, tuple(shard_of))


def into_slots(docs: DataFrame, id_col: str, text_col: str, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), crc), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_bytes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return {r.virtual_slot: (r.bytes, r.n) for r in sums.collect()}


def shard_by_stored_map(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, n_shards: int = 24, grow_to: int | None = None
) -> DataFrame:
    """``shard`` by the latest map stored under ``path``, which is made and stored there if there is none.

    With ``grow_to``, the map is edited for so many shards and stored as the next version; next_shard and next_version
    are each row's under it. Rows move into the new shards only.
    """
    spark = docs.sparkSession
    rows = staged(into_slots(docs, id_col, text_col), "slots")
    sizes = {v: b for v, (b, _) in slot_bytes(rows).items()}
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        balanced(sizes, n_shards).save(spark, path)
    now = SlotMap.load(spark, path)
    if now.n_shards != n_shards:
        raise ValueError(f"the map at {path} has {now.n_shards} shards")
    made = shard_rows(rows, now, id_col)
    if grow_to is None:
        return made
    rebalanced(now, sizes, grow_to).save(spark, path)
    grown = SlotMap.load(spark, path)
    moved = spark.createDataFrame(list(enumerate(grown.shard_of)), "virtual_slot int, next_shard int")
    return made.join(F.broadcast(moved), "virtual_slot").withColumn("next_version", F.lit(grown.version))


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    n_shards: int = 24,
    slots: int = VIRTUAL_SLOTS,
    slot_map: SlotMap | None = None,
) -> DataFrame:
    """``id_col``, size, text_crc32, virtual_slot, map_version, shard and place (gapless in the shard).

    ``slot_map`` is an earlier version to keep to; without one, a map is made for these rows.
    """
    rows = staged(into_slots(docs, id_col, text_col, slots), "slots")
    if slot_map is None:
        slot_map = balanced({v: b for v, (b, _) in slot_bytes(rows).items()}, n_shards, slots)
    return shard_rows(rows, slot_map, id_col)


def shard_rows(rows: DataFrame, slot_map: SlotMap, id_col: str) -> DataFrame:
    """Rows of ``into_slots``, written before, in the shards of the map."""
    stats = slot_bytes(rows)
    start, table = [0] * slot_map.n_shards, []
    for v, s in enumerate(slot_map.shard_of):
        table.append((v, s, start[s]))
        start[s] += stats.get(v, (0, 0))[1]
    places = rows.sparkSession.createDataFrame(table, "virtual_slot int, shard int, _start long")
    in_slot = Window.partitionBy("virtual_slot").orderBy("_id", "text_crc32", "size")
    return (
        rows.withColumn("_rank", F.row_number().over(in_slot).cast("long") - 1)
        .join(F.broadcast(places), "virtual_slot")
        .select(
            F.col("_id").alias(id_col),
            "size",
            "text_crc32",
            "virtual_slot",
            F.lit(slot_map.version).alias("map_version"),
            "shard",
            (F.col("_start") + F.col("_rank")).alias("place"),
        )
    )
