"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window of an item (WINDOW consecutive words) is a set of shingles that a document must hold
whole, so one shingle is prefix enough: the rarest of the window, by counts over all documents.
Document positions whose shingle may be an item's (a bitmap of fixed size says so) become candidate
rows with the few words around them; they meet the items' prefix shingles by an equi-join, and the
words left and right are compared, which bounds length and position and verifies the whole window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.common import ascii_lower, stored

#: What parts words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 3
#: Flags number at least 16 for each different shingle of the items, within these powers of two (512 KB to 64 MB of
#: them). Beyond, more positions get through the flags; the join sorts them out.
LEAST_BITS, MOST_BITS = 22, 29


def _worded(rows: DataFrame, *keep: str | Column) -> DataFrame:
    """rows with w, the words of their text; a split at gaps leaves an empty piece at either end at most."""
    low = rows.select(*keep, F.split(ascii_lower(F.coalesce("text", F.lit(""))), GAP, -1).alias("p"))
    first = (F.get("p", F.lit(0)) == "").cast("int")
    last = ((F.size("p") > 1) & (F.element_at("p", -1) == "")).cast("int")
    names = [c for c in low.columns if c != "p"]
    return low.select(*names, F.when(first + last > 0, F.slice("p", first + 1, F.size("p") - first - last)).otherwise(F.col("p")).alias("w"))


def _token(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(w, i + j) for j in range(k)))


def _flags(tokens: DataFrame, bits: int) -> Column:
    """2**bits flags in an array of longs, as a scalar subquery."""
    spot = tokens.select(F.pmod("token", F.lit(1 << bits)).alias("b"))
    set_ = spot.groupBy(F.expr("shiftright(b, 6)").alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("m"))
    every = tokens.sparkSession.range(1 << (bits - 6)).join(set_, "id", "left").select(F.struct("id", F.coalesce("m", F.lit(0).cast("long")).alias("m")).alias("x"))
    return every.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["m"]).alias("flags")).scalar()


def _same(a: Column, b: Column) -> Column:
    """How many words two arrays share from their beginning."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)) - 1, F.size(equal).cast("long"))


def _candidates(docs: DataFrame, tokens: DataFrame, k: int, window: int) -> DataFrame:
    """Rows (doc_id, text_hash, n_words, pos, token, before, after) where a document may hold one of tokens.

    Each row of docs also has one row with pos -1, so texts are read once.
    """
    w = F.col("w")
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * tokens.count()).bit_length()))
    read = _worded(docs, "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))

    def set_(i: Column) -> Column:
        b = F.pmod(_token(w, i, k), F.lit(1 << bits))
        word = F.get("flags", F.shiftright(b, 6).cast("int"))
        return F.getbit(word, b.bitwiseAND(F.lit(63)).cast("int")) == 1

    spots = F.when(F.size("w") >= k, F.filter(F.sequence(F.lit(0), F.size("w") - k), set_)).otherwise(F.array().cast("array<int>"))
    # Catalyst folds the flags into the filter, so no row carries them
    read = read.select("*", _flags(tokens, bits).alias("flags")).select("doc_id", "text_hash", "w", spots.alias("spots"))
    none = F.array().cast("array<string>")
    whole = F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("token"), none.alias("before"), none.alias("after"))
    around = F.transform(
        "spots",
        lambda p: F.struct(
            p.alias("pos"),
            _token(w, p, k).alias("token"),
            F.reverse(F.slice(w, F.greatest(p - (window - k), F.lit(0)) + 1, F.least(p, F.lit(window - k)))).alias("before"),
            F.slice(w, p + 1, F.lit(window)).alias("after"),
        ),
    )
    # the outer form: for the inner one Spark would infer a filter below, which splits words again for each position
    out = read.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.explode_outer(F.concat(F.array(whole), around)).alias("c"))
    return out.select("doc_id", "text_hash", "n_words", "c.*")


def _hits(docs: DataFrame, items: DataFrame, k: int, window: int) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (doc_id, text_hash, n_words), and stretches (doc_id, text_hash, item_id, first, last) of words inside windows of items of at least k words."""
    w = F.col("w")
    places = items.select("item_id", "w", F.posexplode_outer(F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: _token(w, i, k))).alias("q", "token"))
    tokens = places.select("token").distinct()
    read = stored(_candidates(docs, tokens, k, window))
    found = read.where("pos >= 0").drop("n_words")
    rarity = found.groupBy("token").agg(F.count("*").alias("df"))
    # the rarest shingle of each window, by one pass over an item's shingles in order; a window can occur only if all are there
    n = F.least(F.size("w"), F.lit(window))
    inside = Window.partitionBy("item_id", "w").orderBy("q").rangeBetween(0, window - k)
    ranked = places.join(rarity, "token").withColumns({"least": F.min(F.struct("df", "token", F.col("q").alias("at"))).over(inside), "there": F.count("*").over(inside)})
    prefix = ranked.where((F.col("there") == n - k + 1) & (F.col("q") <= F.size("w") - n)).select("item_id", "w", n.alias("n"), F.col("least.token").alias("token"), F.col("least.at").alias("q")).distinct()
    q = F.col("q")
    prefix = prefix.select(
        "item_id",
        "n",
        "token",
        F.reverse(F.slice(w, F.greatest(q - (n - k), F.lit(0)) + 1, F.least(q, n - k))).alias("i_before"),
        F.slice(w, q + 1, n).alias("i_after"),
    )
    met = found.join(prefix, "token").select("doc_id", "text_hash", "item_id", "pos", "n", _same(F.col("before"), F.col("i_before")).alias("l"), _same(F.col("after"), F.col("i_after")).alias("r"))
    spans = met.where(F.col("l") + F.col("r") >= F.col("n")).select("doc_id", "text_hash", "item_id", (F.col("pos") - F.col("l")).alias("first"), (F.col("pos") + F.col("r") - 1).alias("last"))
    return read.where("pos = -1").select("doc_id", "text_hash", "n_words"), spans


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of digits, letters a-z (A-Z lower-cased) and code points beyond ASCII. A window is
    `window` consecutive words of an item, the whole item if it has fewer (but any). A document word
    is hit if it lies in an occurrence of a window. n_items counts items with a window that occurs;
    items_sha256 is of their ids, sorted as strings and comma-joined. Null and empty texts have no
    words; items without words or without item_id match nothing; items with the same id count once.
    Equal rows get equal results, rows with one doc_id and different texts their own. Empty tables
    give no rows or no hits. Other columns are ignored.
    """
    return _judged(docs, benchmark, window).drop("text_hash")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """contamination() with text_hash, which tells texts of one doc_id, or of none, apart."""
    items = _worded(benchmark.where("item_id is not null"), F.col("item_id").cast("string").alias("item_id")).where(F.size("w") > 0).distinct()
    rows, hits = _hits(docs, items.where(F.size("w") >= SHINGLE), SHINGLE, window)
    # items of one or two words have no shingle of three: a branch for each length that exists
    for (n,) in items.where(F.size("w") < SHINGLE).select(F.size("w")).distinct().collect():
        hits = hits.union(_hits(docs, items.where(F.size("w") == n), n, n)[1])
    covered = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(a["upto"], x["first"] - 1))).alias("n"), F.greatest(a["upto"], x["last"]).alias("upto")),
    )["n"]
    by_doc = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    by_doc = by_doc.select(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), covered.alias("hit"), F.size("items").cast("long").alias("items"), F.array_join("items", ",").alias("list"))
    out = rows.join(by_doc, (F.col("text_hash") == F.col("h_hash")) & F.col("doc_id").eqNullSafe(F.col("h_id")), "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: float = 0.0) -> DataFrame:
    """docs without rows of whose words more than the share `most` is hit; all columns stay.

    Rows are judged by their own text: of rows with one doc_id, or none, the contaminated go and the clean stay, repeated rows
    alike. Null and empty texts stay. An empty benchmark takes nothing away; an empty table gives no rows.
    """
    found = _judged(docs.select("doc_id", "text"), benchmark, window).where(F.col("n_hit") > F.col("n_words") * most)
    found = found.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(found, (own == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_anti")
