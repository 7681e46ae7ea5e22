"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are distinct shingle sets (exact copies share one row), columns are
shingles. Multiplying it by its transpose counts overlaps. Sizes bound which products can matter:

* a pair at similarity t overlaps in at least t * size of either set, so each row keeps only the
  first size - ceil(t * size) + 1 columns of one fixed order (frequent columns last, by a sketch of
  fixed size) and the product over these columns alone meets every pair that can qualify.
  Columns of very many rows are told by the sketch and a count; only the last join, over what is still open, deals them by column;
* an entry of a column is discarded if no other set of that column is near enough in size;
* a cell is discarded before it is counted if sizes and the places of a common column in that order
  bound its overlap below t, and after a count over the kept columns if that count is too low.

The surviving cells are counted exactly over the whole rows: the columns are cut into COLUMN_BLOCKS
blocks, each block's part of the product is computed by itself, and the parts are added up. The product
runs twice: first each column of the kept ones is multiplied by one member (its hub) only, which joins
groups of near copies without forming all their pairs. The second time covers every cell between rows
that are still in different components, so no link that matters is lost. Rows whose sizes are too far
apart never meet there, as the size's place on a logarithmic scale is part of the join's key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm import words
from tidegrid.llm.common import stored
from tidegrid.llm.components import components

SKETCH_BITS = 18
#: 2**23 flags are one MB; more documents than that only let more rows through.
CANDIDATE_BITS = 23
#: Column blocks are named by the highest bits of a shingle's hash.
BLOCK_BITS = 2
#: A bucket of sizes spans this many times the ratio that sizes of a link may have at most.
SIZE_STEPS = 8
#: A column is hot if it has more than this many times the mean of a counter of the sketch, and HOT_LEAST rows at least:
#: there are at most 2**SKETCH_BITS / HOT of them, so that tables of hot columns may be broadcast.
HOT, HOT_LEAST = 8, 4096
#: A row in more cells than this is dealt out, a part of it for each so many cells.
HUB_CELLS = 512
#: A table of this many short rows (under 16 MB) is broadcast, a longer one joined by shuffle.
BROADCAST_ROWS = 1 << 20
#: The same for cells, which are wider and are built into a table on the driver.
BROADCAST_CELLS = 1 << 18


def _tally(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for _, data, bounds in words.chunks(batch, "text"):
            _, s = words.shingles(*words.hashed_words(data, bounds), k)
            total += np.bincount((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
    spot = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(spot), pa.array(total[spot])], ["bucket", "n"])


def _sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document: document numbers, sorted, and hashes, sorted within each."""
    doc, s = words.shingles(*words.hashed_words(data, bounds), k)
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    if len(s):
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        doc, s = doc[new], s[new]
    return doc, s


def _digests(s: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each document's set, whose hashes are s[at[i]:at[i + 1]]."""
    out = []
    for salt in (0x1234567, 0x89ABCDE):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mixed(s + np.uint64(salt)))])
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out


def _signatures(batches: Iterator[pa.RecordBatch], k: int, percent: int, weight: np.ndarray, hot: int) -> Iterator[pa.RecordBatch]:
    """Size, digests and first columns of each set; of these, tail has the ones whose counter lets them be hot."""

    def lists(doc: np.ndarray, s: np.ndarray, rows: int) -> pa.ListArray:
        heads = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=rows))])
        return pa.ListArray.from_arrays(pa.array(heads, pa.int32()), pa.array(s.view(np.int64)))

    for batch in batches:
        for part, data, bounds in words.chunks(batch, "text"):
            doc, s = _sets(data, bounds, k)
            n = np.bincount(doc, minlength=part.num_rows)
            at = np.concatenate([[0], np.cumsum(n)])
            digests = _digests(s, at)
            counter = weight[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            order = np.lexsort((s, counter, doc))
            rank = np.arange(len(s)) - at[doc]
            keep = rank < (n - (n * percent + 99) // 100 + 1)[doc]
            late = counter[order] > hot  # rarest first, so these are a prefix's last
            head, tail = (lists(doc[x], s[order][x], part.num_rows) for x in (keep & ~late, keep & late))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(digests[0]), pa.array(digests[1]), head, tail], ["doc_id", "n_shingles", "d1", "d2", "prefix", "tail"])


def _candidate_blocks(batches: Iterator[pa.RecordBatch], k: int, flags) -> Iterator[pa.RecordBatch]:
    bits = flags.value
    for batch in batches:
        spot = batch.column(2).to_numpy()
        batch = batch.filter(pa.array((bits[spot >> 6] >> (spot & 63)) & 1 == 1))
        for part, data, bounds in words.chunks(batch, "text"):
            doc, s = _sets(data, bounds, k)
            n = np.bincount(doc, minlength=part.num_rows)
            d1, d2 = _digests(s, np.concatenate([[0], np.cumsum(n)]))
            cell = (doc << BLOCK_BITS) + (s >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)  # hashes are sorted, so blocks are runs
            cells, heads = np.unique(cell, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array([*heads, len(s)], pa.int32()), pa.array(s.view(np.int64)))
            own = cells >> BLOCK_BITS
            block = (cells & ((1 << BLOCK_BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), *(pa.array(x[own]) for x in (n, d1, d2)), pa.array(block), lists], ["doc_id", "n_shingles", "d1", "d2", "block", "shingles"])


def _node() -> Column:
    """A number for each set of shingles; documents without any have one of their own."""
    return F.when(F.col("n_shingles") > 0, F.xxhash64("d1", "d2", "n_shingles")).otherwise(F.xxhash64(F.lit("without words"), "doc_id"))


def _meet(cells: DataFrame, rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """cells (a, b) with av and bv, the value of their rows (node, value, keys); both must have equal keys.

    A row in very many cells is copied into parts, so that they don't meet in one task.
    """
    left, right = (rows.select(F.col("node").alias(x), F.col(value).alias(f"{x}v"), *keys) for x in "ab")
    heavy = cells.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HUB_CELLS)
    heavy = stored(heavy.select("a", F.ceil(F.col("n") / HUB_CELLS).cast("int").alias("parts")))
    # a cell is four numbers: where there are few enough they come to the sets, which then move once only, to their partners
    cells = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    n = heavy.count()
    if not n:
        return right.join(cells, "b").join(left, ["a", *keys])
    few = F.broadcast(heavy) if n <= BROADCAST_ROWS else heavy  # 12 bytes a row
    parts = F.coalesce("parts", F.lit(1))
    dealt = right.join(cells, "b").join(few, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int")).drop("parts")
    left = left.join(few, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(left, ["a", "part", *keys]).drop("part")


def _linked(cells: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Cells (a, an, b, bn) whose whole rows are similar enough: overlaps are counted by column block and added up."""
    spark = docs.sparkSession
    met = cells.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = stored(classes.select("node", F.col("low").alias("doc_id")).join(met, "node", "left_semi"))
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << CANDIDATE_BITS))
    spot = ids.select(hashed.alias("b"))
    words_ = spot.groupBy(F.expr("shiftright(b, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("m")).toArrow()
    bits = np.zeros(1 << CANDIDATE_BITS >> 6, np.int64)
    bits[words_["w"].to_numpy()] = words_["m"].to_numpy()
    flags = spark.sparkContext.broadcast(bits)
    found = docs.select("doc_id", "text", hashed.alias("spot")).mapInArrow(partial(_candidate_blocks, k=k, flags=flags), "doc_id long, n_shingles long, d1 long, d2 long, block int, shingles array<long>")
    # documents whose flag another one has set come along: they meet no cell, or are copies of one that does
    blocks = stored(found.select(_node().alias("node"), "block", "shingles"))
    # of copies one stays; few are flagged, as a rule, and the others' sets needn't be dealt out for it
    often = stored(blocks.groupBy("node", "block").agg(F.count("*").alias("n")).where("n > 1").select("node", "block"))
    if often.take(1):
        once = blocks.join(often, ["node", "block"], "left_semi").groupBy("node", "block").agg(F.min("shingles").alias("shingles"))
        blocks = stored(blocks.join(often, ["node", "block"], "left_anti").unionByName(once))
    parts = _meet(cells, blocks, "shingles", "block").select("a", "an", "b", "bn", F.size(F.array_intersect("av", "bv")).alias("overlap"))
    both = parts.groupBy("a", "an", "b", "bn").agg(F.sum("overlap").alias("overlap"))
    return both.where(F.col("overlap") * 100 >= percent * (F.col("an") + F.col("bn") - F.col("overlap"))).select("a", "b", "overlap")


def _cell(x: str, xn: str, y: str, yn: str) -> list[Column]:
    """Columns a, an, b, bn of a pair, the smaller node first."""
    p, q = F.struct(F.col(x).alias("id"), F.col(xn).alias("n")), F.struct(F.col(y).alias("id"), F.col(yn).alias("n"))
    return [F.least(p, q)["id"].alias("a"), F.least(p, q)["n"].alias("an"), F.greatest(p, q)["id"].alias("b"), F.greatest(p, q)["n"].alias("bn")]


def jaccard_classes(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id.

    Two documents link when 100 * overlap >= percent * union of their sets of k-word shingles;
    component_id is the smallest doc_id reachable by links, the document's own included.
    Null and empty texts, and texts without a word, have no shingle and link with nothing.
    Fewer than k words make one shingle. Exact copies form one row of the product. Rows that share
    a doc_id count as linked; a null doc_id has its own shingles counted, no links and a null
    component. Other columns of docs are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tally = docs.select("text").mapInArrow(partial(_tally, k=k), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    weight = np.zeros(1 << SKETCH_BITS, np.int64)  # columns of numbers, as rows of the driver's Python would take a hundred times the room
    weight[tally["bucket"].to_numpy()] = tally["n"].to_numpy()
    most = max(HOT_LEAST, HOT * int(weight.sum()) >> SKETCH_BITS)
    signed = docs.mapInArrow(partial(_signatures, k=k, percent=percent, weight=weight, hot=most), "doc_id long, n_shingles long, d1 long, d2 long, prefix array<long>, tail array<long>")
    signed = stored(signed.select("doc_id", "n_shingles", _node().alias("node"), "prefix", "tail"))
    known = signed.where("doc_id is not null")
    # columns of copies meet; those of the others needn't be dealt out for it
    copied = stored(known.groupBy("node").agg(F.count("*").alias("rows")).where(F.col("rows") > 1).select("node"))
    copied = F.broadcast(copied) if copied.count() <= BROADCAST_ROWS else copied  # 8 bytes a row
    single = known.join(copied, "node", "left_anti").select("node", F.col("doc_id").alias("low"), F.col("n_shingles").cast("int").alias("n"), "prefix", "tail")
    merged = known.join(copied, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("low"), F.first("n_shingles").cast("int").alias("n"), F.first("prefix").alias("prefix"), F.first("tail").alias("tail"))
    classes = stored(single.unionByName(merged))
    # a counter bounds its columns' rows: columns of a tail that have more than most are hot and not dealt by column here,
    # the others are dealt by column once and looked at in windows of at most that many rows
    column = Window.partitionBy("token")
    hot = F.broadcast(stored(classes.select(F.explode("tail").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > most).select("token")))
    tail = classes.select("node", "n", F.size("prefix").alias("first"), F.posexplode("tail").alias("pos", "token")).select("node", "n", (F.col("first") + F.col("pos")).alias("pos"), "token")
    cold = classes.select("node", "n", F.posexplode("prefix").alias("pos", "token")).unionByName(tail.join(hot, "token", "left_anti"))
    # size and place travel as one long: these are the most rows that are dealt here
    cold = cold.select("node", "token", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos")).alias("spot"))
    # an entry stays where the column's next smaller or next larger set is near enough in size; if neither is, no other one is
    by_size = column.orderBy("spot")
    n, less, more = (F.shiftright(x, 32) for x in ("spot", F.lag("spot").over(by_size), F.lead("spot").over(by_size)))
    cold = cold.withColumn("near", (less * 100 >= n * percent) | (n * 100 >= more * percent)).where("near")
    cold = cold.select("node", F.shiftright("spot", 32).cast("int").alias("n"), F.col("spot").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("pos"), "token", F.lit(False).alias("hot"))
    shared = cold.unionByName(tail.join(hot, "token", "left_semi").withColumn("hot", F.lit(True)))
    # the share of a row's columns that it has in common with others; a window of one row's columns, so no longer than a text
    central = (F.count("*").over(Window.partitionBy("node")) * 1000 / F.col("n")).cast("int")
    shared = stored(shared.withColumn("central", central))
    kept = stored(shared.groupBy("node").agg(F.collect_list("token").alias("kept")))

    def possible(an: str, ap: str, bn: str, bp: str):
        """Whether two sets may overlap enough if their first common column is the ap-th and the bp-th of theirs."""
        return F.least(F.col(an) - F.col(ap), F.col(bn) - F.col(bp)) * (100 + percent) >= (F.col(an) + F.col(bn)) * percent

    def counted(cells: DataFrame) -> DataFrame:
        """Cells whose count over kept columns leaves the whole overlap a chance.

        Of the two sets, let the kept columns of A end first. Outside them A has ceil(t * size) - 1 columns,
        inside it meets B in kept columns only: the overlap is below the count plus ceil(t * size of A).
        """
        met = F.size(F.array_intersect("av", "bv")) + F.ceil(F.greatest("an", "bn") * percent / 100) - 1
        return _meet(cells, kept, "kept").where(met >= F.ceil((F.col("an") + F.col("bn")) * percent / (100 + percent))).select("a", "an", "b", "bn")

    # a column's hub: the member with the largest share of columns in common with others, which lies amid its near copies
    cold, warm = shared.where("not hot"), shared.where("hot")
    top = F.max(F.struct("central", F.col("node").alias("id"), "n", "pos"))
    starred = cold.withColumn("top", top.over(column)).unionByName(warm.join(F.broadcast(warm.groupBy("token").agg(top.alias("top"))), "token"))
    starred = starred.select("node", "n", "pos", F.col("top.id").alias("hub"), F.col("top.n").alias("hub_n"), F.col("top.pos").alias("hub_pos"))
    star = starred.where((F.col("hub") != F.col("node")) & possible("hub_n", "hub_pos", "n", "pos")).select(*_cell("hub", "hub_n", "node", "n")).distinct()
    star = stored(counted(stored(star)))
    # rows of one doc_id and different sets
    ids = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n")).where("a < b")
    own = known.select("doc_id", F.col("node").alias("b")).join(ids.select("doc_id", "a"), "doc_id").where("a < b").select("a", "b")
    links = stored(_linked(star, classes, docs, k, percent).select("a", "b").union(own))
    part = components(links)
    # second: columns that still meet more than one component
    near = math.log(100 / percent) + 1e-6  # logarithms of sizes that may link are at most this far apart
    bucket = lambda shift: F.floor((F.log("n") + shift) / (SIZE_STEPS * near))
    at = shared.join(part, "node", "left").select("token", "hot", "node", "n", "pos", F.coalesce("component", "node").alias("c"))
    cold, warm = at.where("not hot"), at.where("hot")
    cold = cold.withColumn("low", F.min("c").over(column)).withColumn("high", F.max("c").over(column)).where("low < high")
    cold = cold.withColumn("w", F.count("*").over(Window.partitionBy("token", "c"))).withColumn("main", F.max(F.struct("w", "c")).over(column)["c"])
    mains = warm.groupBy("token", "c").agg(F.count("*").alias("w")).groupBy("token").agg(F.max_by("c", F.struct("w", "c")).alias("main"), F.min("c").alias("low"), F.max("c").alias("high"))
    warm = warm.join(F.broadcast(mains.where("low < high").select("token", "main")), "token")
    columns = ["token", "node", "n", "pos", "c", "main"]
    at = stored(cold.select(columns).unionByName(warm.select(columns)).withColumn("bucket", bucket(0.0)))
    few = at.where("c <> main").select("token", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("pos").alias("xp"), F.col("c").alias("xc"), F.explode(F.array_distinct(F.array(bucket(-near), bucket(0.0), bucket(near)))).alias("bucket"))
    # every cell between components has an end outside the column's main one; sizes that may link are in one of these buckets
    met = (F.col("xc") != F.col("c")) & possible("xn", "xp", "n", "pos") & ((F.col("c") == F.col("main")) | (F.col("x") < F.col("node")))
    rest = few.join(at, ["token", "bucket"]).where(met).select(*_cell("x", "xn", "node", "n")).distinct()
    rest = stored(counted(stored(rest.join(star, ["a", "b"], "left_anti"))))
    if rest.take(1):
        links = stored(links.union(_linked(rest, classes, docs, k, percent).select("a", "b")))
        part = components(links)
    named = classes.select("node", "low").join(part, "node", "left").select("node", "low", F.coalesce("component", "node").alias("c"))
    lowest = named.groupBy("c").agg(F.min("low").alias("found"))
    named = named.join(lowest, "c").select("node", "found")
    return (
        signed.select("doc_id", "n_shingles", "node")
        .join(named, "node", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("found")).alias("component_id"))
    )


#: Where rows without a doc_id are numbered by their text from: they come after all documents that have one.
_UNNAMED = 1 << 62


def one_per_class(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """docs without all but the first document of each class; columns as in docs.

    Rows that repeat a kept doc_id stay only once, whatever their texts: the one of the smallest hash. Rows without a doc_id are
    documents by their text, and come after those with one: near copies of these go, and of equal texts one stays, a null
    text included. Texts without words are copies of nothing. An empty table gives no rows.
    """
    unnamed = F.lit(_UNNAMED).bitwiseOR(F.xxhash64("text").bitwiseAND(F.lit(_UNNAMED - 1)))
    named = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), unnamed))
    gone = jaccard_classes(named.select(F.col("_doc").alias("doc_id"), "text"), k, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("_doc"))
    return _one_per_id(named.join(gone, "_doc", "left_anti").select(*docs.columns))


def _one_per_id(docs: DataFrame) -> DataFrame:
    """docs with one row for each doc_id, and for each text where that is null."""
    names = docs.columns
    keyed = docs.withColumn("_id", F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("t"), F.sha2("text", 256)), F.lit("")))
    # few rows repeat, as a rule: texts of the others needn't be dealt out
    often = stored(keyed.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select("_id"))
    if not often.take(1):
        return docs
    # an aggregate, as its parts are joined before they are dealt: an id of very many rows meets in no one task
    first = keyed.join(often, "_id", "left_semi").groupBy("_id").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("_row"))
    return keyed.join(often, "_id", "left_anti").select(*names).unionByName(first.select("_row.*"))
