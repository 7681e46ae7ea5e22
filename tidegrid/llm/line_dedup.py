"""Lines that a site repeats, by their frequency within the site; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import stored
from tidegrid.llm.url_filter import host_of

#: Lines end at line breaks and at tags of blocks.
BREAKS = r"[\r\n]+|(?i:</?(?:p|br|div|li|ul|ol|nav|article|section|header|footer|main|aside|h[1-6]|table|tr|td|th|title|head|body|html|script|style|meta|form|pre|blockquote)(?:\s[^>]*)?/?>)"
RATIO = 0.3
#: Up to this size the hosts' lists of lines are broadcast; larger ones are joined, each host dealt over SALTS parts.
BROADCAST_BYTES, SALTS = 8 << 20, 16


def lines_of(html: str, breaks: str = BREAKS) -> Column:
    """Trimmed lines that are not empty, in order."""
    parts = F.split(F.coalesce(html, F.lit("")), breaks, -1)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(lined: DataFrame, ratio: float) -> DataFrame:
    """lined (host, lines) -> host, hashes of lines on more than ratio of its pages and on two at least.

    A host has fewer such lines than its pages have lines on average, divided by ratio: the arrays
    stay short however many pages there are.
    """
    total = lined.groupBy("host").agg(F.count("*").alias("pages")).where("pages > 1")
    # the outer form: for the inner one Spark would infer a filter that splits each page twice
    held = lined.select("host", F.explode_outer(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    often = held.where("line is not null").groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1").join(total, "host").where(F.col("n") > F.col("pages") * ratio)
    return often.groupBy("host").agg(F.collect_list("line").alias("often"))


def _with_lists(lined: DataFrame, often: DataFrame) -> DataFrame:
    """lined (page_id, host, lines) with its host's list (null if it has none); no host meets in one task."""
    often = stored(often)
    n = often.agg(F.coalesce(F.sum(F.octet_length("host") + 8 * F.size("often") + 16), F.lit(0))).first()[0]
    if n <= BROADCAST_BYTES:
        return lined.join(F.broadcast(often), "host", "left")
    dealt = lined.withColumn("salt", F.pmod(F.xxhash64("page_id", "lines"), F.lit(SALTS)).cast("int"))
    every = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(every, ["host", "salt"], "left").drop("salt")


def without_boilerplate(pages: DataFrame, ratio: float = RATIO, breaks: str = BREAKS) -> DataFrame:
    """pages (page_id, url, html) -> page_id, host, n_lines, n_dropped, text.

    A line goes from every page of a host if it is on more than `ratio` of the host's pages and on two of them
    at least. A page counts a line once. Hosts of one page, and pages without host (null url or none with
    '://'), keep all lines. text joins what is kept by line breaks; a null or empty html has no lines and the
    empty text. Repeated rows count as pages each; an empty table gives no rows. Other columns are ignored.
    """
    lined = pages.select("page_id", F.coalesce(host_of("url"), F.lit("")).alias("host"), lines_of("html", breaks).alias("lines"))
    often = boilerplate(lined.where("host <> ''").select("host", "lines"), ratio)
    out = _with_lists(lined, often)
    kept = F.when(F.col("often").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("often", F.xxhash64(x))))
    out = out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
