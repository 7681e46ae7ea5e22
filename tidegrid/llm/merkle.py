"""Merkle manifest of a table: built levels are stored, and a recursive query climbs them for each leaf.

Rows of a source are leaves in the order of their doc_id. Sixteen consecutive nodes make one of the next
level until one is left, the source's subroot; subroots, in the order of their sources, make the root likewise.
Levels are stored as node rows that name their parent. What proves a leaf is found by a recursive query that
starts at each run of leaves and ascends: at every step it appends the siblings, and folds the digest of each
leaf as it is found now (here: tampered with) into the node above. The leaves of one run climb in one row, as they
share all nodes above them; digests travel as 32 bytes and become hex text only where they are hashed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import ascii_lower, forgotten, numbered, shared_dir, stored

#: Nodes that make one of the next level; a digest's bytes.
FANOUT, BYTES = 16, 32
#: The number of the tree over all subroots.
TOP = -1
#: A table of so many sources (names and four numbers) is broadcast, a longer one joined by shuffle.
BROADCAST_SOURCES = 1 << 14
#: So many node rows (of at most 600 bytes) are broadcast.
BROADCAST_NODES = 1 << 13
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Manifest:
    """nodes (tree, level, idx, digest, children, up_tree, up_level, up_idx, place) above the leaves; runs (tree, idx, height,
    leaves: doc_id, leaf, changed) of at most FANOUT leaves; trees (tree, source, n, height), of which deepest is the largest height."""

    nodes: DataFrame
    runs: DataFrame
    trees: DataFrame
    deepest: int
    single: bool


def _hashed(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _above(children: Column) -> Column:
    """The digest over digests (joined bytes), whose hex text is hashed."""
    return _hashed(F.lower(F.hex(children)))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """A row's digest, with some of FIELDS replaced."""
    return _hashed(F.concat(*(_field(changed.get(c, F.col(c))) for c in FIELDS)))


def _without(children: Column, place: Column) -> tuple[Column, Column]:
    """What stands before and after a place among joined digests."""
    return F.substring(children, F.lit(1), place * BYTES), F.substring(children, (place + 1) * BYTES + 1, F.lit(FANOUT * BYTES))


def _height(n: Column) -> Column:
    """How often n nodes are divided by FANOUT until one is left: the hex digits of n - 1."""
    return F.when(n > 1, F.length(F.hex(n - 1))).otherwise(0)


def _linked(nodes: DataFrame, last: Column, beyond: int | None) -> DataFrame:
    """nodes (tree, level, idx, ...) with the place of their parent; last: whether a node is the last of its tree.

    Above it is level `beyond` of the tree of subroots, or nothing.
    """

    def either(inner: Column, outer: Column) -> Column:
        return F.when(~last, inner) if beyond is None else F.when(last, outer).otherwise(inner)

    up = {
        "up_tree": either(F.col("tree"), F.lit(TOP).cast("long")),
        "up_level": either(F.col("level") + 1, F.lit(beyond)),
        "up_idx": either(F.expr(f"idx div {FANOUT}"), F.expr(f"tree div {FANOUT}")),
        "place": either((F.col("idx") % FANOUT).cast("int"), (F.col("tree") % FANOUT).cast("int")),
    }
    return nodes.withColumns(up)


def _joined(nodes: DataFrame) -> DataFrame:
    """nodes (tree, idx, digest) of one level -> tree, idx, children of the next: at most FANOUT of them meet."""
    runs = nodes.groupBy("tree", F.expr(f"idx div {FANOUT}").alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("c"))
    return runs.select("tree", "idx", F.aggregate("c", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["digest"])).alias("children"))


def build(docs: DataFrame, changed: Column | None = None, path: str | None = None) -> Manifest:
    """The manifest of docs (FIELDS), its levels written under path (level=1, ...; by default a folder of this session).

    changed is a row's digest as it would be found now, null where it is the stored one. Rows without a source are a source,
    the first; rows without a doc_id come first in theirs; rows that repeat a doc_id follow each other in the order of their
    digests. Null values count as "-", empty texts as "0:". Other columns of docs are ignored. Without rows there are no nodes.
    """
    spark = docs.sparkSession
    found = docs.select("doc_id", "source", leaf().alias("leaf"), (F.lit(None).cast("binary") if changed is None else changed).alias("changed"))
    found = stored(found.withColumn("at", F.monotonically_increasing_id()))
    sources = stored(found.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_first("source")).withColumn("_row", F.monotonically_increasing_id()))
    trees = stored(numbered(sources, [], "tree").select("tree", "source", "n", _height(F.col("n")).alias("height")))
    kinds = trees.count()
    deepest = trees.agg(F.max("height")).first()[0] or 0
    few = F.broadcast(trees) if kinds <= BROADCAST_SOURCES else trees
    found = found.join(few.select(F.col("source").alias("s"), "tree", "height"), F.col("source").eqNullSafe(F.col("s")))
    # `at` tells repeated rows apart, so that ranges can be cut anywhere
    order = ["tree", F.asc_nulls_first("doc_id"), "leaf", "at"]
    placed = stored(found.select("tree", "height", "doc_id", "leaf", "changed", "at").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    run = F.sort_array(F.collect_list(F.struct("i", "doc_id", "leaf", "changed")))
    runs = stored(numbered(placed, ["tree"], "i").groupBy("tree", F.expr(f"i div {FANOUT}").alias("idx")).agg(F.first("height").alias("height"), run.alias("leaves")))

    if path is None:
        path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
        forgotten(spark, path)
    schema = "tree long, idx long, digest binary, children binary, up_tree long, up_level int, up_idx long, place int"

    def written(children: DataFrame, level: int, last: Column, beyond: int | None) -> DataFrame:
        nodes = _linked(children.withColumn("digest", _above(F.col("children"))).withColumn("level", F.lit(level)), last, beyond)
        nodes.select(*(c.split()[0] for c in schema.split(", "))).write.parquet(f"{path}/level={level}")
        return spark.read.schema(schema).parquet(f"{path}/level={level}")

    def nodes() -> DataFrame:
        return spark.read.schema(schema + ", level int").parquet(path)

    heights = trees.select("tree", "height")
    heights = F.broadcast(heights) if kinds <= BROADCAST_SOURCES else heights
    below = None
    for level in range(1, deepest + 1):
        if below is None:
            children = runs.where("height > 0").select("tree", "idx", "height", F.aggregate("leaves", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["leaf"])).alias("children"))
        else:
            children = _joined(below.where(F.col("up_tree") == F.col("tree"))).join(heights, "tree")
        below = written(children, level, F.col("height") == level, deepest + 1 if kinds > 1 else None)
    if kinds > 1:
        top = runs.where("height = 0").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("leaves")[0]["leaf"].alias("digest"))
        if below is not None:
            top = top.unionByName(nodes().where(f"up_tree = {TOP}").select("up_tree", "tree", "digest").toDF("tree", "idx", "digest"))
        height = len(f"{kinds - 1:x}")
        for level in range(1, height + 1):
            below = written(_joined(top), deepest + level, F.lit(level == height), None)
            top = below.select("tree", "idx", "digest")
    built = spark.createDataFrame([], schema + ", level int") if below is None else nodes()
    return Manifest(built, runs, trees, deepest, kinds == 1)


_CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT tree, idx, folded, digest, subroot, path, up_tree, up_level, up_idx, place FROM {{starts}}
  UNION ALL
  SELECT c.tree, c.idx,
    transform(c.folded, x -> unhex(sha2(lower(hex(concat(substring(n.children, 1, {BYTES} * c.place), x, substring(n.children, {BYTES} * (c.place + 1) + 1)))), 256))) AS folded,
    n.digest, coalesce(c.subroot, CASE WHEN n.up_tree IS NULL OR n.up_tree <> n.tree THEN n.digest END) AS subroot,
    concat(c.path, substring(n.children, 1, {BYTES} * c.place), substring(n.children, {BYTES} * (c.place + 1) + 1)) AS path,
    n.up_tree, n.up_level, n.up_idx, n.place
  FROM climb c JOIN {{nodes}} n ON n.tree = c.up_tree AND n.level = c.up_level AND n.idx = c.up_idx
)
SELECT * FROM climb WHERE up_level IS NULL OR up_level > {{beyond}}
"""


def _climbed(starts: DataFrame, nodes: DataFrame, beyond: int) -> DataFrame:
    """starts after they have climbed nodes, the levels up to `beyond`; stored.

    Spark bounds the rows of a recursive query, which here grow with the table, and deals its result to as many tasks as its last,
    empty step has, which adaptive plans make a single one: both are turned off for this query, and pruning, which recursion can't plan.
    """
    spark = starts.sparkSession
    wanted = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.optimizer.dynamicPartitionPruning.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        return stored(spark.sql(_CLIMB.replace("{beyond}", str(beyond)), starts=starts, nodes=nodes))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def climbed(manifest: Manifest) -> DataFrame:
    """tree, idx, folded (a root for each leaf of the run), root, subroot, path (the siblings of all steps but the first, joined)."""
    runs = manifest.runs
    children = F.aggregate("leaves", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["leaf"]))
    runs = runs.withColumn("children", children)

    def folded(x: Column, i: Column) -> Column:
        before, after = _without(F.col("children"), i)
        now = F.coalesce(x["changed"], x["leaf"])
        return F.when(F.col("height") == 0, now).otherwise(_above(F.concat(before, now, after)))

    lone = F.col("height") == 0
    first = manifest.nodes.where("level = 1 and tree >= 0").select("tree", "idx", "digest", "up_tree", "up_level", "up_idx", "place")
    starts = runs.select("tree", "idx", "height", F.transform("leaves", folded).alias("folded"), F.col("leaves")[0]["leaf"].alias("lone_leaf")).join(first, ["tree", "idx"], "left")
    above = lone & F.lit(not manifest.single)
    starts = starts.select(
        "tree",
        "idx",
        "folded",
        F.when(lone, F.col("lone_leaf")).otherwise(F.col("digest")).alias("digest"),
        F.when(lone, F.col("lone_leaf")).when(F.col("height") == 1, F.col("digest")).alias("subroot"),
        F.unhex(F.lit("")).alias("path"),
        F.when(above, F.lit(TOP).cast("long")).otherwise(F.col("up_tree")).alias("up_tree"),
        F.when(above, F.lit(manifest.deepest + 1)).otherwise(F.col("up_level")).alias("up_level"),
        F.when(above, F.expr(f"tree div {FANOUT}")).otherwise(F.col("up_idx")).alias("up_idx"),
        F.when(above, (F.col("tree") % FANOUT).cast("int")).otherwise(F.col("place")).alias("place"),
    )
    at = stored(starts)
    # all rows of a source, and in the end of the table, meet in the upper nodes: these are few, and are broadcast
    sizes = dict(manifest.nodes.groupBy("level").count().collect())  # a number for each level
    upper, lower = 0, max(sizes, default=0)
    while lower and upper + sizes[lower] <= BROADCAST_NODES:
        upper, lower = upper + sizes[lower], lower - 1
    if lower:
        at = _climbed(at, manifest.nodes.where(F.col("level") <= lower), lower)
    if upper:
        at = _climbed(at, F.broadcast(manifest.nodes.where(F.col("level") > lower)), max(sizes))
    return at.select("tree", "idx", "folded", F.col("digest").alias("root"), "subroot", "path")


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each leaf, digests as hex text.

    proof_sha256 is over all siblings from the leaf's run to the root; folded_root is what the leaf as it is found now, and the
    stored siblings, amount to; it verifies if that is the root.
    """
    text = lambda x: F.lower(F.hex(x))
    own = F.aggregate("leaves", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["leaf"]))
    runs = manifest.runs.select("tree", "idx", "leaves", own.alias("children")).join(climbed(manifest), ["tree", "idx"])
    each = runs.select("children", "folded", "root", "subroot", "path", F.posexplode("leaves").alias("i", "x"))
    before, after = _without(F.col("children"), F.col("i"))
    return each.select(
        F.col("x.doc_id").alias("doc_id"),
        text(F.col("x.leaf")).alias("leaf"),
        text(F.col("subroot")).alias("subroot"),
        text(F.col("root")).alias("root"),
        F.sha2(text(F.concat(before, after, "path")), 256).alias("proof_sha256"),
        text(F.get("folded", "i")).alias("folded_root"),
        (F.get("folded", "i") == F.col("root")).alias("verified"),
    )


def lowered(every: int = 5) -> Column:
    """The digest of rows that are tampered with, null for the others: of each `every`-th doc_id by crc32 the text's A-Z in lower case.

    A null doc_id is never tampered with.
    """
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    return F.when(hit, leaf(text=ascii_lower(F.col("text"))))


def tampered_proofs(docs: DataFrame, every: int = 5) -> DataFrame:
    """proofs() of docs, where each `every`-th row by lowered() is tampered with after the manifest was built; see build() for edges."""
    docs = docs.select(*FIELDS)
    return proofs(build(docs, lowered(every)))
