"""Spelling variants: words that differ by one code point, found by asymmetric chunks, and the usual form of each.

One edit leaves one half of a word as it was. So of two words the shorter contributes its halves, two chunks that don't
overlap, each with its place; the other contributes its positional grams, and a chunk meets a gram of equal text whose
place is at most one off. Which shift a gram can have follows from the lengths: behind the edit it is their difference,
before it none. Grams that are further from a chunk's place would never be joined and aren't made: four a word are left.

A chunk that very many words share is cut again: both words keep the shared half, and of the part that may hold the edit
one half is kept as well. That goes on until a key meets few words, or the open part is one code point long, which an
alphabet bounds. So candidates stay in proportion to words, whatever the vocabulary, and no pair is lost or met twice.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import LOWER, UPPER, stored

#: Shortest words, and how often a word occurs at least.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs so many times as often as its variant, at least.
FORM_RATIO = 10
#: A key is cut again if its pairs are more than this many times its rows.
MOST_PAIRS_A_ROW = 16
#: A task hands its counts over when it holds so many words.
HELD_WORDS = 1 << 18
#: A table of so many hashes (8 MB) is broadcast, a longer one joined by shuffle.
BROADCAST_KEYS = 1 << 20

_RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_ASCII_LOWER = str.maketrans(UPPER, LOWER)


def as_found(doc_id: int | None, run: str) -> str:
    """The word that a lower-cased run stands for: of one in 31 (by crc32 of document and run) a code point is missing.

    In a document without a doc_id every run stands for itself.
    """
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lowered: Counter[str] = Counter()
            for run, n in Counter(_RUN.findall(text or "")).items():
                lowered[run.translate(_ASCII_LOWER)] += n
            for run, n in lowered.items():
                word = as_found(doc_id, run)
                if len(word) >= LEAST_LENGTH:
                    total[word] += n
            if len(total) > HELD_WORDS:
                yield out()
                total.clear()
    yield out()


def words(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> word, n: every word that occurs twice at least, in all of all texts; null texts have none."""
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _open(low: Column, high: Column) -> Column:
    """The two halves of a stretch that may hold the edit, as structs a, b."""
    middle = F.floor((low + high) / 2).cast("int")
    return F.array(F.struct(low.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), high.alias("b")))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (word, size, shift, a, b) with key: a hash of all but the stretch [a, b) of the shorter word, which the longer one has shifted behind it."""
    before, after = F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.col("b") + F.col("shift") + 1, F.length("word"))
    return rows.withColumn("key", F.xxhash64("size", "a", "b", before, after))


def _cut(rows: DataFrame) -> DataFrame:
    """rows with each stretch [a, b) replaced by its halves."""
    halves = rows.withColumn("o", F.explode(_open(F.col("a"), F.col("b"))))
    return _keyed(halves.withColumns({"a": F.col("o.a"), "b": F.col("o.b")}).drop("o", "key"))


def _near(hot: DataFrame) -> DataFrame:
    return F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot


def pairs(vocabulary: DataFrame) -> DataFrame:
    """vocabulary (word, n; words distinct) -> word, n, other, other_n: each two words that differ by one code point, once.

    Of words of different lengths the shorter is word, else the smaller one.
    """
    size = F.length("word")
    base = vocabulary.select("word", "n", size.alias("size"), F.lit(0).alias("shift"))
    chunks = base.withColumn("gram", F.lit(False))
    shifted = F.explode(F.when(F.col("size") > LEAST_LENGTH, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    grams = base.drop("shift").withColumn("shift", shifted).withColumn("size", F.col("size") - F.col("shift")).withColumn("gram", F.lit(True))
    names = ["word", "n", "size", "shift", "gram"]
    rows = _cut(chunks.select(names).unionByName(grams.select(names)).withColumns({"a": F.lit(0), "b": F.col("size")}))
    settled = []
    while True:
        load = rows.groupBy("key").agg(F.count_if("gram").alias("g"), F.count_if(~F.col("gram")).alias("c"), F.max(F.col("b") - F.col("a")).alias("open"))
        hot = stored(load.where((F.col("open") > 1) & (F.col("g") * F.col("c") > MOST_PAIRS_A_ROW * (F.col("g") + F.col("c")))).select("key"))
        if not hot.take(1):
            settled.append(rows)
            break
        settled.append(rows.join(_near(hot), "key", "left_anti"))
        rows = stored(_cut(rows.join(_near(hot), "key", "left_semi").select(*names, "a", "b")))
    met = []
    for part in settled:
        left = part.where(~F.col("gram")).select("key", "word", "n", "a", "b", F.col("b") == F.col("size"))
        left = left.toDF("key", "word", "n", "a", "b", "last")
        right = part.where("gram").select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), "shift")
        inner = lambda x: F.substring(x, F.col("a") + 1, F.col("b") - F.col("a"))
        # the first difference lies in the open stretch, so of the halves that both fit one is taken
        here = F.col("last") | (inner("word") != inner("other"))
        ordered = (F.col("shift") == 1) | (F.col("word") < F.col("other"))
        met.append(left.join(right, "key").where(ordered & here & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n"))
    out = met[0]
    for part in met[1:]:
        out = out.unionByName(part)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) -> word, root: the end of the chain of forms. A form is FORM_RATIO times as frequent, so chains are short."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        # each step doubles the part of the chain that a word has behind it
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if not step.where("moved").take(1):
            return at


def grouped(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> word, form, root, n, n_near, form_n: a row for each word of at least seven code points that occurs twice.

    Words are runs of Latin letters with A-Z lower-cased, one in 31 without a code point (see as_found()). A word's form is its
    most frequent near word (ties: the first in code-point order), if FORM_RATIO times as frequent; its root the end of that
    chain, or itself. Null and empty texts have no words; repeated rows count each time; other columns are ignored.
    """
    known = stored(words(docs))
    found = stored(pairs(known))
    both = found.select("word", "other", "other_n").unionByName(found.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), F.col("other")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    usual = F.col("best.other_n") >= FORM_RATIO * F.col("n")
    out = known.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best.other")).alias("form"), F.when(usual, F.col("best.other_n")).alias("form_n"))
    out = stored(out)
    roots = _roots(out.where("form is not null").select("word", "form"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
