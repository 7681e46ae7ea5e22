"""Personal data by boosting over candidate spans; DataFrame operations only.

Generators of high recall propose spans (which may overlap), each with features of its format and
context. Labels never come from the features: those of cards, addresses, phones and account numbers are checksums and
ranges, counted over all documents; those of spelt addresses, national numbers and keys, which nothing can check, are
the truth of planted examples (see plants()): such data in varied surroundings, and commits, digests, long names, order
numbers and sentences that look like it. Boosted
trees are fitted on the driver to counts by features, a table of fixed size, and become Column expressions. Scores are calibrated on the same
counts by isotonic regression, and a generator's threshold is the least score that is right in PRECISION of the
cases. Spans that pass a strict rule always stay; all others are chosen by their score alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import stored

#: The first four have base patterns, whose spans are counted.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE_KINDS = 4
# The base patterns, written so that no run of characters is scanned from each of its positions.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Further generators: addresses spelt to escape a scan, national numbers, account numbers, and runs that may be keys.
SPELT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++"
NATIONAL = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
KEY = r"(?i)(?:token|secret|passw(?:or)?d|pwd|key|auth|credential)s?[\x20\x22']*[:=][\x20\x22']*$"
CUE = r"(?i)mail|contact|write|phone|tel|call|fax|mobile|\bip\b|addr|host|server|card|visa|account|pay"
PRECISION, TREES, RATE = 0.95, 40, 0.3
#: So many examples are planted, whatever the table's size.
PLANTS = 6000
#: Generators whose spans no checksum covers.
PLANTED = (("email", 1), ("phone", 1), ("secret", 0))
FEATURES = ("kind", "form", "before", "after", "cue", "digits", "marks", "groups", "shape")
_OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.ascii(F.substring(digits, n - i + 1, F.lit(1))) - 48
        twice = x * 2
        return total + F.when(i % 2 == 1, x).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _mod97(value: Column) -> Column:
    """The remainder of an account number read with its first four places last and letters as numbers."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.left(plain, F.lit(4)))

    def add(total: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (total * 100 + code - 55) % 97).otherwise((total * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def _valid(kind: str, value: Column, digits: Column) -> Column:
    if kind == "iban":
        return _mod97(value) == 1
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.rlike(_OCTET))
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    return F.length(digits).between(9, 15)


def _char(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)


def _shape(kind: str, form: int, value: Column) -> Column:
    """Of a run, which characters it holds (those that read like a word are the low ones); of a spelt address, how its dots are."""
    if kind == "email" and form == 1:
        return F.when(value.rlike(r"(?:\[dot\]|\(dot\))"), 2).otherwise(value.rlike(r"\.\x20").cast("int"))
    if kind != "secret":
        return F.lit(0)
    low, up, digit = value.rlike("[a-z]"), value.rlike("[A-Z]"), value.rlike("[0-9]")
    parted = value.rlike("^[A-Za-z0-9]{1,12}(?:[_/-][A-Za-z0-9]{1,12})+$")
    return F.when(~digit, F.when(low & up, 1).otherwise(0)).when(value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$"), 2).when(parted, 5).when(low & up, 3).otherwise(4)


def _spans(found: str, gaps: str, kind: str, form: int) -> Column:
    """Spans of one generator from its matches and the texts between them."""
    m, g = F.col(found), F.col(gaps)

    def add(acc: Column, i: Column) -> Column:
        value, gap, after = F.get(m, i), F.get(g, i), F.get(g, i + 1)
        start = acc["at"] + gap["n"]
        end = start + F.length(value)
        digits = F.regexp_replace(value, "[^0-9]", "")
        n = F.length(digits)
        cue = gap["tail"].rlike(KEY if kind == "secret" else CUE)
        sure = F.lit(False) if (kind, form) in PLANTED else _valid(kind, value, digits)
        span = F.struct(
            start.alias("start"),
            end.alias("end"),
            sure.alias("sure"),
            F.lit(KINDS.index(kind)).alias("kind"),
            F.lit(form).alias("form"),
            _char(F.right(gap["tail"], F.lit(1))).alias("before"),
            _char(after["head"]).alias("after"),
            cue.cast("int").alias("cue"),
            F.when(n == 0, 0).when(n < 9, 1).when(n < 13, 2).when(n < 17, 3).when(n < 20, 4).otherwise(5).alias("digits"),
            F.least(F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")), F.lit(4)).alias("marks"),
            value.rlike(r"^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1").cast("int").alias("groups"),
            _shape(kind, form, value).alias("shape"),
        )
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    empty = "array<struct<start:int,end:int,sure:boolean,kind:int,form:int,before:int,after:int,cue:int,digits:int,marks:int,groups:int,shape:int>>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(empty).alias("out"))
    return F.when(F.size(m) > 0, F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), first, add)["out"]).otherwise(first["out"])


#: kind, form, pattern, and what a text must contain to be searched
_GENERATORS: tuple[tuple[str, int, str, Callable[[Column], Column]], ...] = (
    ("email", 0, EMAIL, lambda t: t.contains("@")),
    ("email", 1, SPELT, lambda t: t.contains("at]") | t.contains("at)")),
    ("ip", 0, IP, lambda t: t.rlike(r"[0-9]\.[0-9]")),
    ("card", 0, CARD, lambda t: t.rlike("[0-9]")),
    ("phone", 0, PHONE, lambda t: t.contains("+")),
    ("phone", 1, NATIONAL, lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}")),
    ("iban", 0, IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2}")),
    ("secret", 0, SECRET, lambda t: t.rlike("[A-Za-z0-9+/_-]{20}")),
)


def candidates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, spans: an array of all generators' spans with their features."""
    text = F.col("t")
    cols = []
    for i, (_, _, pattern, needs) in enumerate(_GENERATORS):
        has = needs(text)
        gap = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(24)).alias("tail"), F.left(p, F.lit(1)).alias("head")))
        cols += [F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias(f"m{i}"), F.when(has, gap).alias(f"g{i}")]
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", *cols)
    return read.select("doc_id", F.concat(*(_spans(f"m{i}", f"g{i}", kind, form) for i, (kind, form, _, _) in enumerate(_GENERATORS))).alias("spans"))


def plants(spark: SparkSession, n: int = PLANTS, seed: int = 0) -> DataFrame:
    """n examples: doc_id, text, kind (its place in KINDS), form, start, end (of the example's span), good: whether it is personal data.

    Values and surroundings come from digests of the number and the seed; another seed gives others.
    """
    r = F.col("r")
    digits, letters, mixed = F.translate(r, "abcdef", "271828"), F.translate(r, "0123456789abcdef", "aeinrstolmudghpc"), F.base64(F.unhex(r))

    def some(salt: int, *choices: object) -> Column:
        """One of the choices."""
        return F.get(F.array(*(c if isinstance(c, Column) else F.lit(c) for c in choices)), F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(choices))).cast("int"))

    def part(text: Column, start: int, *lengths: int) -> Column:
        return F.substring(text, F.lit(start), some(start, *lengths))

    word, other, third = part(letters, 1, 3, 5, 8), part(letters, 11, 4, 6, 9), part(letters, 21, 3, 6, 10)
    named = F.concat(word, F.lit(" "), some(1, "token", "secret", "password", "api_key", "auth", "Credentials", "TOKEN"), some(2, ' = "', ": ", "=", ": '", " = ", '": "'))
    end, plain = some(3, '"', " ", "'", "\n", ",", ""), some(4, " ", ", ", "\n", "")
    code, number = part(r, 1, 32, 40, 64), [F.substring(digits, at, size) for at, size in ((1, 3), (4, 3), (7, 4))]
    dashed = F.concat_ws("-", *number)
    cases: list[tuple[str, int, bool, Column, Column, Column]] = [
        ("secret", 0, True, named, code, end),
        ("secret", 0, True, named, part(mixed, 1, 24, 32, 43), end),
        ("secret", 0, True, named, part(letters, 31, 20, 26, 40), end),
        ("secret", 0, True, some(5, '"', "'"), part(mixed, 3, 32, 40, 43), some(5, '"', "'")),
        ("secret", 0, False, some(6, "commit ", "sha256:", 'digest "', "etag: ", "revision ", F.concat(word, F.lit(" "))), code, end),
        ("secret", 0, False, F.concat(word, F.lit(" ")), part(letters, 41, 20, 24, 33), plain),
        ("secret", 0, False, F.concat(word, some(7, " ", ".", "(")), F.concat(*(F.initcap(x) for x in (word, other, third, part(letters, 51, 10, 12)))), plain),
        ("secret", 0, False, F.concat(word, some(8, " ", ": ", " (")), some(9, *(F.concat_ws(mark, word, other, part(letters, 61, 9, 11), third, F.substring(digits, 1, 4)) for mark in ("_", "-", "/"))), plain),
        ("phone", 1, True, some(10, "call ", "phone: ", "tel. ", "Fax ", "mobile "), some(11, dashed, F.concat_ws(".", *number), F.concat_ws(" ", *number)), plain),
        ("phone", 1, True, F.concat(word, F.lit(" ")), F.concat(F.lit("("), number[0], F.lit(") "), F.concat_ws("-", *number[1:])), plain),
        ("phone", 1, False, some(12, "order ", "part ", "no. ", "ticket ", "isbn "), dashed, plain),
        ("phone", 1, False, F.concat(F.substring(digits, 11, 2), some(13, "\t", " | ")), some(14, F.concat_ws(" ", *number), F.concat_ws(".", *number)), some(13, "\t", " | ")),
        ("email", 1, True, some(15, "write to ", F.concat(word, F.lit(" "))), F.concat(other, some(16, " [at] ", "(at)", "[at]"), third, some(17, " [dot] ", "(dot)", "[dot]"), some(18, "org", "com")), plain),
        ("email", 1, True, some(15, "write to ", F.concat(word, F.lit(" "))), F.concat(other, some(16, " [at] ", "(at)", "[at]"), third, some(18, ".org", ".com")), plain),
        ("email", 1, False, F.concat(word, F.lit(" ")), F.concat(other, some(19, " (at) ", " [at] "), third, F.lit(". "), F.initcap(word)), some(20, " ", "\n", "")),
    ]
    one = [F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(form).alias("form"), F.lit(good).alias("good"), before.alias("b"), value.alias("v"), after.alias("a")) for kind, form, good, before, value, after in cases]
    # a generator keeps the long expressions out of those that read the rows
    digests = spark.range(-(-n // len(cases))).select("id", F.sha2(F.concat_ws(":", F.lit(seed), "id"), 512).alias("r"))
    rows = digests.select("id", F.posexplode(F.array(*one)).alias("i", "x")).select((F.col("id") * len(cases) + F.col("i")).alias("doc_id"), "x.*")
    start = F.length("b")
    return rows.where(F.col("doc_id") < n).select("doc_id", F.concat("b", "v", "a").alias("text"), "kind", "form", start.alias("start"), (start + F.length("v")).alias("end"), "good")


def labelled(found: DataFrame, examples: DataFrame) -> DataFrame:
    """FEATURES, n, good: cases and right ones, of candidates() by their rules and of plants() by what they are."""
    planted = F.lit(False)
    for kind, form in PLANTED:
        planted = planted | ((F.col("kind") == KINDS.index(kind)) & (F.col("form") == form))
    ruled = found.select(F.explode("spans").alias("s")).select("s.*").where(~planted).select(*FEATURES, F.col("sure").alias("label"))
    truth = examples.select("doc_id", F.struct("kind", "form", "start", "end").alias("t"), "good")
    spans = candidates(examples).select("doc_id", F.explode("spans").alias("s")).join(truth, "doc_id")
    known = spans.where(F.struct("s.kind", "s.form", "s.start", "s.end") == F.col("t")).select("s.*", "good").select(*FEATURES, F.col("good").alias("label"))
    return ruled.unionByName(known).groupBy(*FEATURES).agg(F.count("*").alias("n"), F.count_if("label").alias("good"))


# Boosting over counted patterns ------------------------------------------------------------------

Split = tuple[int, int]  # feature, value
Tree = tuple[Split, Sequence[tuple[Split, float, float]]]  # root, then for yes and no: a split and its two leaves


def _best(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, splits: Sequence[Split]) -> tuple[Split, float, float]:
    """The split of the largest gain, and the two leaves' values; x has a column for each split: whether a row goes left."""
    g1, h1 = grad @ x, hess @ x
    g2, h2 = grad.sum() - g1, hess.sum() - h1
    i = int(np.argmax(np.round(g1 * g1 / (h1 + 1) + g2 * g2 / (h2 + 1), 9)))
    return splits[i], float(RATE * g1[i] / (h1[i] + 1)), float(RATE * g2[i] / (h2[i] + 1))


def boosted(rows: Sequence[tuple[tuple[int, ...], int, int]]) -> list[Tree]:
    """Trees of depth two for (features, cases, right ones), by Newton steps on the logistic loss.

    A pattern weighs by the root of its share of its generator's cases: sizes of tables don't matter, and no frequent
    pattern drowns the others.
    """
    makers: dict[tuple[int, ...], int] = {}
    for features, n, _ in rows:
        makers[features[:2]] = makers.get(features[:2], 0) + n
    weight = np.array([100 * math.sqrt(n / makers[features[:2]]) for features, n, _ in rows])
    rate = np.array([good / n for _, n, good in rows])
    splits = sorted({(f, v) for row, _, _ in rows for f, v in enumerate(row)})
    if len(splits) <= len(FEATURES):
        return []
    x = np.array([[row[f] == v for f, v in splits] for row, _, _ in rows], float)
    score, trees = np.zeros(len(rows)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess = weight * (rate - p), weight * p * (1 - p)
        root, _, _ = _best(x, grad, hess, splits)
        left = x[:, splits.index(root)] == 1
        tree = (root, [_best(x[side], grad[side], hess[side], splits) for side in (left, ~left)])
        trees.append(tree)
        score = score + np.array([leaf(tree, row) for row, _, _ in rows])
    return trees


def leaf(tree: Tree, row: Sequence[int]) -> float:
    (f, v), sides = tree
    (f2, v2), yes, no = sides[0 if row[f] == v else 1]
    return yes if row[f2] == v2 else no


def thresholds(rows: Sequence[tuple[tuple[int, ...], int, int]], trees: Sequence[Tree]) -> dict[tuple[int, int], float]:
    """For each generator (kind, form) the least score from which on PRECISION of the cases are right; infinite if none is.

    Rates may not rise as scores fall: scores that break this are pooled. Each pool must be right that often, and all
    from the threshold on together, by a smoothed rate.
    """
    out = {}
    for maker in sorted({x[:2] for x, _, _ in rows}):
        pools: list[tuple[float, int, int]] = []
        for score, n, good in sorted(((sum(leaf(t, x) for t in trees), n, good) for x, n, good in rows if x[:2] == maker), reverse=True):
            while pools and (pools[-1][0] == score or good * pools[-1][1] >= pools[-1][2] * n):
                _, n2, good2 = pools.pop()
                n, good = n + n2, good + good2
            pools.append((score, n, good))
        least, cases, right = math.inf, 0, 0
        for score, n, good in pools:
            cases, right = cases + n, right + good
            if good < PRECISION * n:
                break
            if (right + 1) / (cases + 2) >= PRECISION:
                least = score
        out[maker] = least
    return out


def _scored(span: Column, trees: Sequence[Tree]) -> Column:
    def test(split: Split) -> Column:
        return span[FEATURES[split[0]]] == split[1]

    total = F.lit(0.0)
    for root, (yes, no) in trees:
        inner = [F.when(test(s), a).otherwise(b) for s, a, b in (yes, no)]
        total = total + F.when(test(root), inner[0]).otherwise(inner[1])
    return total


def _joined(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    order = F.sort_array(F.array_distinct(F.transform(spans, lambda s: F.struct(s["kind"].alias("k"), s["start"].alias("s"), s["end"].alias("e")))))
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(order, lambda s: F.concat(F.get(names, s["k"]), F.lit(":"), s["s"].cast("string"), F.lit(":"), s["e"].cast("string"))), ",")


def find_spans(docs: DataFrame, n_plants: int = PLANTS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, base, chosen: arrays of strictly valid spans, and of all that are to be redacted.

    A span has kind (its place in KINDS), start and end in code points; base ones are of the first kinds. A chosen
    span that no rule makes sure is chosen by the trees; it overlaps no sure one of its kind.
    """
    found = stored(candidates(docs))
    # one row for each combination of features: at most the product of their few values
    rows = sorted(((tuple(r[f] for f in FEATURES), r["n"], r["good"]) for r in labelled(found, stored(plants(docs.sparkSession, n_plants))).collect()))
    trees = boosted(rows)
    least = thresholds(rows, trees)
    sure = F.filter("spans", lambda s: s["sure"])

    def added(s: Column) -> Column:
        score, bar = _scored(s, trees), F.lit(math.inf)
        for (kind, form), value in least.items():
            if value < math.inf:
                bar = F.when((s["kind"] == kind) & (s["form"] == form), F.lit(value - 1e-9)).otherwise(bar)
        met = F.exists("sure", lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return ~s["sure"] & (score >= bar) & ~met

    base = F.filter("sure", lambda s: s["kind"] < BASE_KINDS)
    return found.select("doc_id", sure.alias("sure"), "spans").select("doc_id", base.alias("base"), F.concat("sure", F.filter("spans", added)).alias("chosen"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret for each row of docs (doc_id, text).

    Counts and digest are of base spans; spans lists the chosen ones too, n_secret counts those of keys. Null and empty texts have none
    (the digest is of the empty string). Repeated rows get equal results, a null doc_id stays, other columns
    are ignored, an empty table gives no rows.
    """
    found = find_spans(docs)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:BASE_KINDS])]
    secrets = F.size(F.filter("chosen", lambda s: s["kind"] == KINDS.index("secret"))).cast("long")
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("chosen")).alias("spans"), secrets.alias("n_secret"))
