"""URL filter by rules and by the reputation of hosts, with DataFrame operations only.

Pages on hosts that some rule names are labelled outcomes: bad where a block rule decides, good
elsewhere. Rates of bad pages are shrunk by beta-binomial priors from the whole to the suffix, from the suffix to the
registered domain and from there to the host; each prior's strength is estimated from how much the
rates of that level differ. Pages without a rule are judged by a bound of their host's posterior.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import ascii_lower

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Suffixes of several names under which domains are registered; pass a longer list where one is at hand.
SUFFIXES = tuple(
    f"{name}.{country}"
    for country, names in {
        "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org", "nz": "ac co geek gen govt net org school",
        "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or pe re", "br": "com edu gov net org", "cn": "ac com edu gov net org",
        "tw": "com edu gov idv net org", "hk": "com edu gov idv net org", "sg": "com edu gov net org per", "in": "ac co edu firm gen gov ind net nic org res",
        "za": "ac co gov net org web", "il": "ac co gov muni net org", "mx": "com edu gob net org", "ar": "com edu gob gov int net org",
        "tr": "bel com edu gov k12 net org", "id": "ac co go net or sch web", "th": "ac co go in mi net or", "my": "com edu gov net org",
        "ph": "com edu gov net org", "vn": "com edu gov net org", "ua": "com edu gov in net org", "pl": "com edu gov net org", "ru": "com msk net org spb",
        "es": "com edu gob nom org", "pt": "com edu gov org", "gr": "com edu gov net org", "at": "ac co gv or", "hu": "co org", "eg": "com edu gov net org",
    }.items()
    for name in names.split()
)
#: A host is blocked where even the lower end (5 %) of its share of bad pages is above one half: bad pages are then
#: the rule there, and blocking does less harm than allowing at equal costs.
Z, MOST_BAD = 1.645, 0.5


def _rest(url: str) -> Column:
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.lit(2**31 - 1))).otherwise("")


def host_of(url: str) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: str) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _on(host: Column, rule: str) -> Column:
    name = rule.partition("/")[0]
    return (host == name) | host.endswith(f".{name}")


def name_of(host: Column) -> Column:
    """The host's name without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def _labels(name: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """Registered domain and suffix of a name; an address of digits or a single name is its own."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    second = F.concat_ws(".", F.get(parts, n - 2), F.get(parts, n - 1)).isin(*suffixes) & (n > 2)
    plain = (n < 2) | name.rlike(r"^[0-9.]+$") | name.endswith(".") | name.startswith("[")
    keep = F.when(second, 3).otherwise(2)
    domain = F.when(plain, name).otherwise(F.array_join(F.slice(parts, n - keep + 1, keep), "."))
    suffix = F.when(plain, name).otherwise(F.array_join(F.slice(parts, n - keep + 2, keep - 1), "."))
    return domain, suffix


def _strength(groups: DataFrame) -> Column:
    """How many pages a level's prior counts as, from its groups (n, bad), by moments; within 1 and 1000."""
    p = F.sum("bad") / F.sum("n")
    one = groups.agg(p.alias("p"), F.var_samp(F.col("bad") / F.col("n")).alias("v"), F.avg(1 / F.col("n")).alias("i"))
    between = F.col("v") - F.col("p") * (1 - F.col("p")) * F.col("i")
    m = F.when(between > 1e-9, F.col("p") * (1 - F.col("p")) / between - 1).otherwise(1000.0)
    return one.select(F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), m)), F.lit(1000.0)).alias("m")).scalar()


def reputations(pages: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """pages (name, reviewed, bad) -> name, rate, bound: the posterior mean and lower bound of bad pages."""
    counts = pages.groupBy("name").agg(F.count_if("reviewed").alias("n"), F.count_if(F.col("reviewed") & F.col("bad")).alias("bad"))
    domain, suffix = _labels(F.col("name"), suffixes)
    hosts = counts.select("name", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    seen = "n > 0"
    m_suffix, m_domain, m_host = (_strength(x.where(seen)) for x in (suffixes, domains, hosts))
    prior = suffixes.agg(F.coalesce(F.try_divide(F.sum("bad") + 1, F.sum("n") + 2), F.lit(0.5)).alias("p")).scalar()
    by_suffix = suffixes.select("suffix", ((m_suffix * prior + F.col("bad")) / (m_suffix + F.col("n"))).alias("s"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", "suffix", ((m_domain * F.col("s") + F.col("bad")) / (m_domain + F.col("n"))).alias("d"))
    weight = m_host + F.col("n")
    rate = (m_host * F.col("d") + F.col("bad")) / weight
    out = hosts.join(by_domain, ["domain", "suffix"]).select("name", rate.alias("rate"), weight.alias("w"))
    return out.select("name", "rate", (F.col("rate") - Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("w") + 1))).alias("bound"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, outcomes: DataFrame | None = None, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, bad_rate, bound.

    The longest rule that fits decides (of equals the first by code point); without one, the verdict is
    block where the host's lower bound is above MOST_BAD, else allow. Labelled outcomes are the pages on hosts that a
    rule names, and those of outcomes (url, bad) where given; user names and ports don't tell hosts apart there. A null
    url, or one without '://', has an empty host and path and is judged like a host of its own. Repeated rows are judged
    alike and count as pages each; an empty table gives no rows. Other columns are ignored.
    """
    rules = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    split = pages.select("page_id", F.coalesce(host_of("url"), F.lit("")).alias("host"), F.coalesce(path_of("url"), F.lit("")).alias("path"))
    host = F.col("host")
    fits = [(verdict, rule, _on(host, rule) & F.col("path").startswith("/" + rule.partition("/")[2])) for verdict, rule in rules]
    rule = F.coalesce(*(F.when(fit, rule) for _, rule, fit in fits), F.lit(None).cast("string"))
    said = F.coalesce(*(F.when(fit, verdict) for verdict, _, fit in fits), F.lit(None).cast("string"))
    reviewed = F.lit(False)
    for _, name in rules:
        reviewed = reviewed | _on(host, name)
    rows = split.withColumns({"rule": rule, "said": said, "reviewed": reviewed, "name": name_of(host)})
    seen = rows.select("name", "reviewed", (F.coalesce("said", F.lit("")) == "block").alias("bad"))
    if outcomes is not None:
        seen = seen.unionByName(outcomes.select(name_of(F.coalesce(host_of("url"), F.lit(""))).alias("name"), F.col("bad").isNotNull().alias("reviewed"), F.coalesce("bad", F.lit(False)).alias("bad")))
    method = F.when(F.col("bound") > MOST_BAD, "block").otherwise("allow")
    return rows.join(reputations(seen, suffixes), "name").select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), F.round("rate", 6).alias("bad_rate"), F.round("bound", 6).alias("bound"))
