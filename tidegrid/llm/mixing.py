"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Equal rows count as one record with copies. Each source's records are dealt by hash into blocks of about
BLOCK_ROWS; the hash also permutes the blocks. A source's target is met by whole passes over its blocks and, for the rest, by the first of the
permuted blocks; only the block in which the rest ends is looked into. All blocks drawn are then
split among the output shards: a tree halves the shards again and again, and at each node a multivariate
hypergeometric draw says how many blocks of each source go left, so the quotas are whole and exact.
Every shard takes its own run of each source's permuted blocks and shuffles its rows locally.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import WORD, numbered, running, stored

BLOCK_ROWS = 1024
#: Beyond so many blocks in all, blocks grow instead: the tree's draws are exact up to 10**9 block slots.
MOST_BLOCKS = 1 << 27
#: Copies of one record are written by different tasks in chunks of this many.
CHUNK = 4096
#: Up to this size a table of one row per source is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Target:
    source: str | None
    rows: int
    size: int
    target: float

    def blocks(self, block_rows: int) -> int:
        return -(-self.rows // block_rows) or 1

    @property
    def passes(self) -> int:
        return int(self.target // self.size) if self.size else 0

    @property
    def rest(self) -> int:
        return round(self.target - self.passes * self.size)


def targets(sources: Sequence[tuple[str | None, int, int]], weights: Sequence[float], share: float, cap: float) -> list[Target]:
    """(source, rows, size) -> targets: weights repeat over the sources by code point, null last.

    share times all sizes are dealt out by weight; a target stops at cap times its source's size and
    what is above goes to the others by weight, until none is above.
    """
    order = sorted(sources, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [float(weights[i % len(weights)]) for i in range(len(order))]
    total, full = share * sum(s[2] for s in order), set()
    while True:
        open_ = [i for i in range(len(order)) if i not in full]
        left = total - sum(cap * order[i][2] for i in full)
        w = sum(weight[i] for i in open_)
        goal = {i: left * weight[i] / w for i in open_}
        above = {i for i in open_ if goal[i] > cap * order[i][2]}
        if not above:
            break
        full |= above
    return [Target(s[0], s[1], s[2], cap * s[2] if i in full else goal[i]) for i, s in enumerate(order)]


def split(quotas: np.ndarray, n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """n_shards rows of quotas (fewer than 10**9 in all) that add up to quotas; each node draws what goes to its left half."""
    if n_shards == 1:
        return quotas[None, :]
    left = n_shards // 2
    take, room, total = np.zeros_like(quotas), int(quotas.sum()) * left // n_shards, int(quotas.sum())
    for i, n in enumerate(quotas):  # one source after the other, each given those before
        take[i] = rng.hypergeometric(int(n), total - int(n), room)
        room, total = room - int(take[i]), total - int(n)
    return np.concatenate([split(take, left, rng), split(quotas - take, n_shards - left, rng)])


def _name(source: str) -> Column:
    """A key for grouping that keeps null apart from any text."""
    return F.concat(F.when(F.col(source).isNull(), "0").otherwise("1"), F.coalesce(F.col(source).cast("string"), F.lit("")))


def _per_source(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """rows (key first) as a DataFrame, marked for broadcast where they are small: a hot source then stays where it is."""
    n = sum(len(r[0].encode()) + 8 * sum(len(x) if isinstance(x, list) else 1 for x in r) for r in rows)
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block, in permuted order, as many copies of each record as still fit into the rest.

    The shortest one left out is taken too where the sum then is nearer to the rest than without it.
    """
    rows = rows.sort_values(["h", "doc_id", "size"], na_position="first")
    left, chosen = int(rows["left"].iloc[0]), []
    for size, copies in zip(rows["size"], rows["copies"], strict=True):
        chosen.append(min(int(copies), left // int(size)) if size else 0)
        left -= int(size) * chosen[-1]
    out = [(int(size), i) for i, (size, copies) in enumerate(zip(rows["size"], rows["copies"], strict=True)) if size and chosen[i] < copies]
    if out and min(out)[0] - left < left:
        chosen[min(out)[1]] += 1
    return rows.assign(n=chosen)[["doc_id", "key", "h", "size", "n"]]


@dataclass(frozen=True)
class Plan:
    records: DataFrame  # doc_id, size, key, h, copies, block, source_size, target: a row for each different document
    sources: list[Target]
    blocks: DataFrame  # key, block, draws: whole passes over the block, slots: these and one more where the rest ends in it
    edge: DataFrame  # doc_id, key, h, size, n: how many copies are drawn once more from the block in which the rest ends


def plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> Plan:
    """How often each document of docs (doc_id, text, source) is drawn; see mix_sizes()."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    records = stored(sized.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("copies")))
    # one row a source: names of sources are metadata
    found = targets([tuple(x) for x in records.groupBy("source").agg(F.count("*"), F.sum(F.col("size") * F.col("copies"))).collect()], weights, share, cap)
    block_rows = BLOCK_ROWS * (sum(t.rows for t in found) // (BLOCK_ROWS * MOST_BLOCKS) + 1)
    rows = [("0" if t.source is None else "1" + t.source, t.size, float(t.target), t.blocks(block_rows), t.passes, t.rest) for t in found]
    goal = _per_source(spark, rows, "key string, source_size long, target double, n_blocks int, passes int, rest long")
    records = records.withColumn("key", _name("source")).drop("source").join(goal, "key").withColumn("block", F.pmod("h", "n_blocks").cast("int"))
    by_block = stored(records.groupBy("key", "block", "passes", "rest").agg(F.sum(F.col("size") * F.col("copies")).alias("words")))
    placed = running(by_block, "words", ["key"], "block").withColumn("left", F.col("rest") - F.col("_before"))
    whole = (F.col("left") >= F.col("words")).cast("int")
    blocks = placed.select("key", "block", (F.col("passes") + whole).alias("draws"), F.when((F.col("left") > 0) & (whole == 0), F.col("left")).alias("left"))
    blocks = stored(blocks.withColumn("slots", F.col("draws") + F.col("left").isNotNull().cast("int")))
    ends = blocks.where("left is not null").select("key", "block", "left")
    # one block a source, of about BLOCK_ROWS records however often each occurs
    edge = records.join(ends, ["key", "block"]).select("doc_id", "key", "h", "size", "copies", "left").groupBy("key").applyInPandas(_fill, "doc_id long, key string, h long, size long, n long")
    return Plan(records.drop("n_blocks", "passes", "rest"), found, blocks.drop("left"), stored(edge.where("n > 0")))


def _dealt(p: Plan, n_shards: int, seed: int) -> Plan:
    """p whose blocks have shards: the output shard of each of the block's slots, by the splitting tree's quotas.

    A block that isn't drawn takes no slot; it has one shard still, for its rows without words.
    """
    spark = p.records.sparkSession
    per_source = {r[0]: r[1] for r in p.blocks.groupBy("key").agg(F.sum("slots")).collect()}
    keys = sorted(per_source)
    quotas = split(np.array([per_source[k] for k in keys] or [0], np.int64), n_shards, np.random.default_rng(seed))
    ends = np.cumsum(quotas, axis=0)
    bounds = _per_source(spark, [(k, [int(x) for x in ends[:, i]]) for i, k in enumerate(keys)], "key string, ends array<long>")
    shards = F.expr(f"transform(sequence(0, greatest(slots, 1) - 1), i -> least(size(filter(ends, e -> e <= _before + i)), {n_shards - 1}))")
    placed = running(p.blocks, "slots", ["key"], "block").join(bounds, "key")
    return replace(p, blocks=stored(placed.select("key", "block", "draws", shards.alias("shards"))))


def _drawn(p: Plan) -> DataFrame:
    """Records of p with their block's shards, draws: how often each copy is drawn, and n: how many copies are drawn once more.

    A record without words has no share in any target and is drawn once.
    """
    edge = p.edge.withColumnsRenamed({"doc_id": "e_id", "key": "e_key", "h": "e_h", "size": "e_size"})
    met = F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("h") == F.col("e_h")) & (F.col("key") == F.col("e_key")) & (F.col("size") == F.col("e_size"))
    out = p.records.join(p.blocks, ["key", "block"]).join(edge, met, "left").drop("e_id", "e_key", "e_h", "e_size", "block")
    draws = F.when(F.col("size") == 0, 1).otherwise(F.col("draws"))
    return out.withColumns({"draws": draws, "n": F.coalesce("n", F.lit(0))})


def _copies(records: DataFrame) -> DataFrame:
    """A row, numbered from 1 by copy, for each copy of a record; those of a frequent one are spread over tasks."""
    plain = records.where(F.col("copies") <= CHUNK).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    chunked = records.where(F.col("copies") > CHUNK).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK))))
    chunked = chunked.repartition("h", "chunk").withColumn("copy", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, F.least(F.col("copies"), (F.col("chunk") + 1) * CHUNK))))
    return plain.unionByName(chunked.drop("chunk"))


def _place(h: str, copy: Column, draw: Column) -> Column:
    """Random within a shard."""
    return F.xxhash64(h, copy, draw)


def mix_sizes(docs: DataFrame, n_shards: int = 16, seed: int = 7, **options) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source_size, target, taken, draws, mix_shard, mix_order.

    The rows of mix(), one for each document instead of each draw: mix_shard and mix_order are arrays, an
    element a draw, empty where there is none. size counts words (null text: 0), target is the source's
    (see targets()), taken sums size over the draws, at most cap times size for a whole cap. Documents are
    taken whole; the last block's share is rounded to the nearer side, so a source's sum is off its target by at most
    half of the smallest document that the last block has left (one word more, as the rest is a whole number). A hash of doc_id and text decides, so reruns agree. A null source is a source of its own, an
    empty one too. Sources without words have target 0. Equal rows count each; an empty table gives no
    rows. Other columns are ignored.
    """
    p = _dealt(plan(docs, seed=seed, **options), n_shards, seed)
    out = _copies(_drawn(p)).withColumn("draws", F.col("draws") + (F.col("copy") <= F.col("n")).cast("int"))
    out = out.withColumn("mix_shard", F.slice("shards", F.lit(1), F.col("draws")))
    order = F.transform("mix_shard", lambda _, i: _place("h", F.col("copy"), i + 1))
    taken = F.aggregate("mix_shard", F.lit(0).cast("long"), lambda total, _: total + F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws", "mix_shard", order.alias("mix_order"))


def mix(docs: DataFrame, n_shards: int = 16, seed: int = 7, **options) -> DataFrame:
    """docs, each row as often as the mix draws it, with mix_shard and mix_order.

    mix_shard comes from the splitting tree, mix_order is random within it: see in_order(). A row without
    words (a null text, say) has no share in any target and stays once. Rows equal in doc_id, text and source count
    each; which of them are drawn once more, where only some are, is open. A null doc_id or source is a value like
    others; an empty table gives no rows. Columns of docs stay; names that clash are replaced.
    """
    p = _dealt(plan(docs, seed=seed, **options), n_shards, seed)
    chosen = _drawn(p).where("draws + n > 0")
    chosen = chosen.select(F.col("doc_id").alias("c_id"), F.col("h").alias("c_h"), F.col("key").alias("c_key"), F.col("shards").alias("mix_shards"), F.col("draws").alias("mix_draws"), F.col("n").alias("mix_more"), F.col("copies").alias("mix_copies"))
    rows = docs.withColumns({"mix_h": F.xxhash64(F.lit(seed), "doc_id", "text"), "mix_id": F.col("doc_id"), "mix_key": _name("source")})
    met = F.col("mix_id").eqNullSafe(F.col("c_id")) & (F.col("mix_h") == F.col("c_h")) & (F.col("mix_key") == F.col("c_key"))
    names = [c for c in docs.columns if c not in ("mix_shard", "mix_order")]
    keep = [*names, "mix_h", "mix_copy", "mix_draws", "mix_more", "mix_shards"]
    out = rows.join(chosen.where("mix_copies = 1"), met).withColumn("mix_copy", F.lit(1).cast("long")).select(*keep)
    repeated = stored(chosen.where("mix_copies > 1"))
    if repeated.take(1):  # equal rows are told apart by number
        told = rows.withColumn("mix_id", F.coalesce(F.col("mix_id").cast("string"), F.lit(""))).join(repeated.withColumn("c_id", F.coalesce(F.col("c_id").cast("string"), F.lit(""))), met)
        told = stored(told.withColumn("_row", F.monotonically_increasing_id()))
        out = out.unionByName(numbered(told, ["mix_id", "mix_h", "mix_key"], "mix_copy").withColumn("mix_copy", F.col("mix_copy") + 1).select(*keep))
    times = F.col("mix_draws") + (F.col("mix_copy") <= F.col("mix_more")).cast("int")
    out = out.withColumn("mix_times", times).where("mix_times > 0").withColumn("mix_draw", F.explode(F.expr("sequence(1, cast(mix_times as int))")))
    return out.select(*names, F.get("mix_shards", F.col("mix_draw") - 1).alias("mix_shard"), _place("mix_h", F.col("mix_copy"), F.col("mix_draw")).alias("mix_order"))


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows of mix() shard after shard, shuffled within each: the files written from it, one after the other, are the mix.

    A shard is cut into ranges of mix_order, so no task holds a whole one.
    """
    return mixed.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")
