"""A training corpus from documents: quality, near copies, benchmark passages, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. Every stage takes null
texts, null and repeated doc_ids, columns beyond those of documents (whatever their names) and tables
without rows; what becomes of such rows stands in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import decontaminate, jaccard_join, mixing, quality, sharding
from tidegrid.llm.common import stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from this stage's documents, doesn't reject.

    Null and empty texts are scored like others, repeated rows alike. Without labels of both kinds nothing goes, except
    where all labels are bad.
    """
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def first_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each class of near copies, by sets of five words and a similarity of 0.8.

    Of rows of one doc_id one stays; of rows without a doc_id one for each text. Texts without words are no copies.
    """
    return jaccard_join.one_per_class(docs, k=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts and a null doc_id stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them: not at all, once or twice; written by output shard, shuffled within each.

    Texts without words stay once. A null source is a source of its own.
    """
    return mixing.in_order(mixing.mix(docs)).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in 40 shards of nearly equal bytes, by the columns of op1; null texts count as empty, a null doc_id is hashed like any."""
    return sharding.shard(docs)


STAGES = [("quality", good), ("near_duplicates", first_of_each_class), ("decontamination", clean), ("mixing", mixed), ("sharding", sharded)]

#: SQL can't express the learnt classifier and the drawn mix; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order, each on all that the one before kept; an empty documents table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
