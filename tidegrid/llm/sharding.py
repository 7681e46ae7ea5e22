"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots. Bytes are summed per slot, and a small versioned
map says which shard holds each slot. Rebalancing edits the map; records never move between slots.
A slot far above the mean (of rows that repeat, say) is divided into parts, each with a shard of its own
in the map; records of a divided slot are dealt over its parts.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import forgotten, numbered, shared_dir, stored

SLOTS = 8192
#: A map is edited where some shard is further than this share of the mean away from it.
SLACK = 0.02

Load = tuple[int, int, int, int]  # slot, part, bytes, rows


@dataclass(frozen=True)
class SlotMap:
    """Shards of the parts of slots: rows (slot, part, shard). A slot's parts count from 0."""

    version: int
    n_shards: int
    parts: tuple[tuple[int, int, int], ...]


def slotted(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of every row; texts are read and left behind."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return out.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_slots)).cast("int"))


def divisions(records: DataFrame, n_slots: int = SLOTS, old: SlotMap | None = None) -> dict[int, int]:
    """The number of parts of each slot that holds a record: 1, or what makes parts about as large as a mean slot.

    Slots above twice the mean of bytes or of rows are divided, so there are at most three times n_slots parts.
    No slot gets fewer parts than the old map gives it.
    """
    found = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    size, rows = (max(1, sum(x[i] for x in found) // n_slots) for i in (1, 2))
    out: dict[int, int] = {}
    for slot, part, _ in old.parts if old else ():
        out[slot] = max(out.get(slot, 1), part + 1)
    for slot, b, n in found:
        heavy = b > 2 * size or n > 2 * rows
        out[slot] = max(out.get(slot, 1), min(n, max(b // size, n // rows)) if heavy else 1)
    return out


def dealt(records: DataFrame, parts: dict[int, int]) -> DataFrame:
    """records (of slotted(), stored, with _row: a unique number) with their part of the slot."""
    rows = [(slot, n) for slot, n in parts.items() if n > 1]
    if not rows:
        return records.withColumn("part", F.lit(0))
    few = records.sparkSession.createDataFrame(rows, "vslot int, parts int")  # at most as many rows as slots
    out = records.join(F.broadcast(few), "vslot", "left")
    return out.withColumn("part", F.pmod(F.xxhash64("_row"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def part_loads(records: DataFrame) -> list[Load]:
    """Bytes and rows of each part of a slot, however many records there are."""
    found = records.groupBy("vslot", "part").agg(F.sum("size"), F.count("*")).collect()
    return sorted(tuple(x) for x in found)


def first_map(loads: list[Load], n_shards: int) -> SlotMap:
    """Version 1: the largest part goes to the lightest shard, and so on."""
    heap = [(0, 0, shard) for shard in range(n_shards)]
    shard = {}
    for slot, part, size, _ in sorted(loads, key=lambda x: (-x[2], x[:2])):
        held, count, to = heapq.heappop(heap)
        shard[slot, part] = to
        heapq.heappush(heap, (held + size, count + 1, to))
    return SlotMap(1, n_shards, tuple((*k, v) for k, v in sorted(shard.items())))


def rebalanced(old: SlotMap, loads: list[Load], n_shards: int) -> SlotMap:
    """The next version for n_shards (at least as many): parts leave shards above the mean for the lightest one.

    A part moves only where that makes the heavier of the two shards lighter and leaves it about the mean. Parts that the old map doesn't
    name come in first. Where nothing moves, the old map stays, its version too.
    """
    if n_shards < old.n_shards:
        raise ValueError("the number of shards can only grow")
    size = {(slot, part): b for slot, part, b, _ in loads}
    shard = {(slot, part): s for slot, part, s in old.parts}
    known = dict(shard)
    held, own = [0] * n_shards, [[] for _ in range(n_shards)]
    for key, s in shard.items():
        held[s] += size.get(key, 0)
        own[s].append(key)
    light = [(held[s], s) for s in range(n_shards)]
    heapq.heapify(light)

    def lightest() -> int:
        while light[0][0] != held[light[0][1]]:  # an outdated entry
            heapq.heappop(light)
        return light[0][1]

    def put(key: tuple[int, int], to: int) -> None:
        shard[key] = to
        held[to] += size.get(key, 0)
        heapq.heappush(light, (held[to], to))

    for key in sorted(size.keys() - shard.keys(), key=lambda k: (-size[k], k)):
        put(key, lightest())
    left, n = sum(held), n_shards
    for b in sorted(size.values(), reverse=True):  # a part above the mean has a shard to itself: the others share the rest
        if n == 1 or b <= left / n:
            break
        left, n = left - b, n - 1
    mean = left / n
    uneven = min(held) < mean * (1 - SLACK) or sum(h > mean * (1 + SLACK) for h in held) > n_shards - n
    for s in sorted(range(old.n_shards), key=lambda x: (-held[x], x)):
        for key in sorted(own[s], key=lambda k: (-size.get(k, 0), k)):
            b, to = size.get(key, 0), lightest()
            if not uneven or held[s] <= mean:
                break
            if b and held[to] + b < held[s] and held[s] - b >= mean * (1 - SLACK / 2):
                held[s] -= b
                heapq.heappush(light, (held[s], s))
                put(key, to)
    if shard == known and n_shards == old.n_shards:
        return old
    return SlotMap(old.version + 1, n_shards, tuple((*k, v) for k, v in sorted(shard.items())))


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))


def write_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Add a version to the table of maps: a folder of its own, which must not exist."""
    rows = [(*p, slot_map.n_shards) for p in slot_map.parts]
    df = spark.createDataFrame(rows, "slot int, part int, shard int, n_shards int")
    df.coalesce(1).write.mode("error").parquet(f"{path}/version={slot_map.version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the newest unless one is named; as many rows as parts reach the driver."""
    version = version or max(_versions(spark, path))
    rows = spark.read.parquet(f"{path}/version={version}").orderBy("slot", "part").collect()
    return SlotMap(version, rows[0].n_shards if rows else 0, tuple((r.slot, r.part, r.shard) for r in rows))


def placed(records: DataFrame, slot_map: SlotMap) -> DataFrame:
    """records (of dealt()) with shard, and slot: the place in the shard, gapless from 0.

    Places are numbered in parts of shards, and the parts' counts are added up: no task sorts a whole shard.
    """
    # at most three rows for each virtual slot, a fixed number
    parts = records.sparkSession.createDataFrame(list(slot_map.parts), "vslot int, part int, shard int")
    return numbered(records.join(F.broadcast(parts), ["vslot", "part"]), ["shard"], "slot")


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Put all rows of docs (doc_id, text) into n_shards shards of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes plus 16), text_crc32, law ('bytes'), shard, slot (place in the
    shard), grown_shard (null: bytes, not the key alone, decide), vslot, part and map_version. The map is
    written to path and read from there: version 1 where there is none (a folder of this session without a path),
    else the newest, edited for these rows' loads and stored as a further version if that moves anything.
    A null text counts as empty, a null doc_id hashes like any value. Equal rows share a virtual slot; where they
    make it heavy it is divided, so they spread over shards too. Further columns are ignored. An empty table gives
    no rows. A record larger than a mean shard has a shard nearly to itself.
    """
    spark = docs.sparkSession
    records = stored(slotted(docs, n_slots).withColumn("_row", F.monotonically_increasing_id()))
    if path is None:
        path = f"{shared_dir(spark)}/maps/{uuid.uuid4().hex}"
        forgotten(spark, path)
    old = read_map(spark, path) if _versions(spark, path) else None
    records = dealt(records, divisions(records, n_slots, old))
    loads = part_loads(records)
    new = rebalanced(old or first_map(loads, n_shards), loads, n_shards)
    if new != old:
        write_map(spark, new, path)
    slot_map = read_map(spark, path)
    out = placed(records, slot_map)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "part", F.lit(slot_map.version).alias("map_version"))
