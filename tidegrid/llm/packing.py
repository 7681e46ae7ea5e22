"""Best-fit packing of token sequences by a grouping genetic algorithm, on islands whose elites migrate.

Documents become pieces of at most `size` tokens; whole pieces fill a sequence alone. The others are dealt at random into
blocks of bounded length, each a packing of its own. A block is bred on several islands: an island is a row with a
few packings (a bin for each piece), the first of them by best fit. Crossover takes whole well-filled bins of one packing
into another, takes out the bins that now hold a piece twice, and puts the pieces that lost their place back by best fit,
largest first. After each epoch the best packings of an island move on to the next one, which is a shuffle by
block and island; a block that needs no more bins than its tokens do at least is settled.

Bins that stay loose in any block are taken apart and dealt into new, far fewer blocks, until these are one: so the
number of sequences comes near to the least possible over the whole table, though no task sees more than a block.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.common import stored
from tidegrid.llm.tokens import WordIds

SIZE = 2048
#: The id behind each document.
END = 0
#: Pieces of a block on average, and the fullness in sequences that it has at least where pieces are short.
BLOCK, BLOCK_BINS = 2048, 64
#: Islands of a block, packings of an island, how many of them move on, and what an epoch breeds.
ISLANDS, PACKINGS, ELITES, CHILDREN, EPOCHS = 2, 5, 2, 10, 2
#: Bins with more than the first part of them empty are taken apart for the next round, the loosest ones, up to the second part of a block's.
LOOSE, MOST_LOOSE = 1 / 64, 1 / 16


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, size: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    words = WordIds(tokenizer)
    end = np.array([END], "<u4").tobytes()
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = words.ids(text or "") + end
            for piece, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at : at + 4 * size]
                rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32, ids (little-endian, null unless asked for).

    A document is its ids and END; only longer ones than size are cut. Null and empty texts are END alone.
    """
    made = partial(_pieces, tokenizer=tokenizer, size=size, with_ids=with_ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def best_fit(lengths: np.ndarray, bins: np.ndarray, todo: np.ndarray, fill: list[int], size: int) -> int:
    """Puts the pieces `todo`, in their order, where they leave least room; bins is filled in, fill grows. Returns the number of bins."""
    room = sorted((size - f) << 20 | b for b, f in enumerate(fill) if f < size)
    for i in todo.tolist():
        n = int(lengths[i])
        at = bisect_left(room, n << 20)
        if at < len(room):
            left, b = room[at] >> 20, room[at] & 0xFFFFF
            del room[at]
        else:
            left, b = size, len(fill)
            fill.append(0)
        bins[i] = b
        fill[b] += n
        if left > n:
            insort(room, (left - n) << 20 | b)
    return len(fill)


def first_packing(lengths: np.ndarray, size: int, rng: np.random.Generator | None = None) -> np.ndarray:
    """Best fit, largest first; with rng in an order that is a little off."""
    order = np.argsort(-(lengths if rng is None else lengths * rng.uniform(0.8, 1.25, len(lengths))), kind="stable")
    bins = np.empty(len(lengths), np.int32)
    best_fit(lengths, bins, order, [], size)
    return bins


def crossed(lengths: np.ndarray, base: np.ndarray, donor: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """base with whole well-filled bins of donor; bins of base that share a piece with these are taken apart, their other pieces best-fitted."""
    fill = np.bincount(donor, lengths)
    well = np.flatnonzero(fill >= np.median(fill))
    chosen = np.zeros(len(fill), bool)
    chosen[well[rng.random(len(well)) < rng.uniform(0.05, 0.5)]] = True
    given = chosen[donor]
    hit = np.zeros(base.max() + 1, bool)
    hit[base[given]] = True
    # a few of the loosest bins are taken apart too, else their pieces could only move along with others
    loose = np.bincount(base, lengths)
    hit[np.argsort(loose)[: 1 + len(loose) // 32]] = True
    kept = ~hit[base] & ~given
    number = np.cumsum(~hit) - 1
    out = np.full(len(base), -1, np.int32)
    out[kept] = number[base[kept]]
    first = int((~hit).sum())
    out[given] = first + (np.cumsum(chosen) - 1)[donor[given]]
    placed = out >= 0
    todo = np.flatnonzero(~placed)
    todo = todo[np.argsort(-lengths[todo], kind="stable")]
    start = np.bincount(out[placed], lengths[placed], minlength=first + int(chosen.sum())).astype(int).tolist()
    best_fit(lengths, out, todo, start, size)
    return out


def worth(lengths: np.ndarray, bins: np.ndarray, size: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones beside emptier ones; smaller is better."""
    fill = np.bincount(bins, lengths) / size
    return len(fill), -float(np.square(fill).sum())


def bred(lengths: np.ndarray, packings: list[np.ndarray], size: int, seed: int, fresh: bool, packs: int = PACKINGS, children: int = CHILDREN) -> list[np.ndarray]:
    """One epoch of an island, best packing first: none is bred once the bins are as few as the tokens allow."""
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // size)
    ranked = sorted(((worth(lengths, p, size), k, p) for k, p in enumerate(packings)), key=lambda x: x[:2])
    count = len(ranked)

    def add(p: np.ndarray) -> None:
        nonlocal count
        insort(ranked, (worth(lengths, p, size), count, p), key=lambda x: x[:2])
        count += 1

    if not ranked:
        add(first_packing(lengths, size, rng if fresh else None))
    while ranked[0][0][0] > least and len(ranked) < packs:
        add(first_packing(lengths, size, rng))
    for _ in range(children):
        if ranked[0][0][0] <= least:
            break
        a, b = (min(rng.integers(len(ranked), size=2)) for _ in range(2))
        add(crossed(lengths, ranked[a][2], ranked[b][2], size, rng))
        del ranked[packs:]
    return [p for *_, p in ranked[:packs]]


def _epoch(frames: Iterator[pd.DataFrame], size: int, epoch: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            lengths = np.asarray(row.lengths, np.int64)
            known = [np.asarray(p, np.int32) for p in row.packings]
            seed = zlib.crc32(f"{row.block} {row.island} {epoch} {len(lengths)}".encode())
            best = bred(lengths, known, size, seed, row.island > 0)
            n, filled = worth(lengths, best[0], size)
            out.append((row.block, row.island, lengths, best, n, filled, n == -(-int(lengths.sum()) // size)))
        yield pd.DataFrame(out, columns=["block", "island", "lengths", "packings", "bins", "worth", "settled"])


def _blocks(rest: DataFrame, blocks: int, size: int) -> DataFrame:
    """rest (row, length) -> row, length, block, bin: each of the blocks packed for itself."""
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    held = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", F.col("length").cast("int").alias("length")))).alias("p"))
    held = stored(held.select("block", F.col("p.row").alias("rows"), F.col("p.length").alias("lengths")))
    none = F.array().cast("array<array<int>>")
    islands = held.select("block", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), "lengths", none.alias("packings"))
    schema = "block long, island int, lengths array<int>, packings array<array<int>>, bins int, worth double, settled boolean"
    done = None
    for epoch in range(EPOCHS):
        spread = islands.repartition(max(1, blocks * ISLANDS // 8), "block", "island")  # a fixed number: rows are few and long to work on
        bred_ = stored(spread.mapInPandas(partial(_epoch, size=size, epoch=epoch), schema))
        done = bred_ if done is None else done.unionByName(bred_)
        if epoch + 1 == EPOCHS:
            break
        over = bred_.groupBy("block").agg(F.bool_or("settled").alias("over")).where("over")
        left = bred_.join(over, "block", "left_anti")
        if not left.take(1):
            break
        moved = left.withColumns({"island": ((F.col("island") + 1) % ISLANDS).cast("int"), "packings": F.slice("packings", 1, ELITES)})
        both = left.unionByName(moved).select("block", "island", "lengths", "packings")
        islands = both.groupBy("block", "island").agg(F.first("lengths").alias("lengths"), F.flatten(F.collect_list("packings")).alias("packings"))
    best = done.groupBy("block").agg(F.min_by(F.col("packings")[0], F.struct("bins", "worth", "island")).alias("bins"))
    return held.join(best, "block").select("block", F.explode(F.arrays_zip("rows", "lengths", "bins")).alias("x")).select(F.col("x.rows").alias("row"), F.col("x.lengths").cast("long").alias("length"), "block", F.col("x.bins").alias("bin"))


def _held(rest: DataFrame) -> tuple[int, int]:
    row = rest.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    return row["n"], row["tokens"]


def placed(rest: DataFrame, size: int = SIZE) -> DataFrame:
    """rest (row: a unique long, length) -> row, sequence_id, offset: in as few sequences of at most size as it can."""
    parts, out = [], rest
    n, tokens = _held(out)
    while n or not parts:
        k, blocks = len(parts), max(1, min(-(-n // BLOCK), tokens // (size * BLOCK_BINS)))
        packed = _blocks(out, blocks, size)
        own, block = Window.partitionBy("block", "bin"), Window.partitionBy("block")  # both bounded
        here = F.lit(k << 56) + F.shiftleft("block", 24) + F.col("bin")
        rank = F.dense_rank().over(block.orderBy("fill", "bin"))
        loose = (F.col("fill") < size - int(size * LOOSE)) & (rank <= F.ceil((F.max("bin").over(block) + 1) * MOST_LOOSE))
        packed = packed.withColumn("fill", F.sum("length").over(own)).withColumn("tight", F.lit(blocks == 1) | ~loose)
        packed = stored(
            packed.select(
                "row",
                "length",
                here.alias("sequence_id"),
                (F.sum("length").over(own.orderBy(F.desc("length"), "row")) - F.col("length")).alias("offset"),
                "tight",
            )
        )
        out = packed.where("not tight").select("row", "length")
        before, (n, tokens) = tokens, _held(out)
        if 2 * tokens > before:  # loose bins are the rule here, and dealing them anew wouldn't change it
            parts.append(packed.select("row", "sequence_id", "offset"))
            break
        parts.append(packed.where("tight").select("row", "sequence_id", "offset"))
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    return done


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for): every piece in its place.

    tokenizer is the path of a word vocabulary (tokenizers' JSON), on every executor. Null and empty texts are one token, the
    end; repeated rows and rows without a doc_id are documents of their own; other columns are ignored; without rows there are none.
    """
    cut = stored(pieces(docs, tokenizer, size, with_ids).withColumn("row", F.monotonically_increasing_id()))
    alone = cut.where(F.col("length") == size).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done = alone.unionByName(placed(cut.where(F.col("length") < size).select("row", "length"), size))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return cut.join(done, "row").select(names)


def sequences(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """docs (doc_id, text) -> sequence_id, length, doc_ids, ids (little-endian unsigned 32-bit): what a trainer reads. See packed()."""
    rows = packed(docs, tokenizer, size, with_ids=True)
    held = rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return held.select("sequence_id", "length", F.col("p.doc_id").alias("doc_ids"), F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
