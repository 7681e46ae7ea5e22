"""The operators as registered queries, over whole tables, and DuckDB SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import decontaminate, jaccard_join, licenses, line_dedup, maxscore, merkle, mixing, packing, pii, quality, sharding, url_filter, variants
from tidegrid.llm.common import LOWER, UPPER, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_boilerplate(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_proofs(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only here: the library takes the vocabulary's path as a parameter

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Query]:
    found = (op1_sharding, op2_jaccard_join, op3_pii, op4_quality, op5_licenses, op6_line_dedup, op7_decontamination, op8_top_k, op9_mixing, op10_url_filter, op11_merkle_manifest, op12_spelling_variants, op13_packing)
    return {f.__name__: f for f in found}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = s.doc_id
"""

_NORMAL = "' ' || regexp_replace(lower(trim(x)), '[^\\p{L}\\p{N}]+', '  ', 'g') || ' '"
for _a, _b in licenses.SPELLINGS:
    _NORMAL = f"replace({_NORMAL}, {_quoted(f' {_a.replace(' ', '  ')} ')}, {_quoted(f' {_b} ')})"
_LINES = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: CASE WHEN regexp_matches(lower(trim(x)), {_quoted(licenses.COPYRIGHT)}) THEN '' ELSE trim(regexp_replace({_NORMAL}, ' +', ' ', 'g')) END), lambda y: y <> '')"
_LONG = "".join(f" UNION ALL SELECT {_quoted(n)}, {_quoted(f)}, {w}, {_quoted(d)}" for n, f, w, d in licenses.KNOWN_DIGESTS)
OP5 = f"""
WITH t AS (SELECT license, array_to_string({_LINES}, ' ') AS t FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licenses.KNOWN)}) v(license, text)),
k AS (SELECT DISTINCT license, string_split(t, ' ')[1] AS first, len(string_split(t, ' ')) AS n, sha256(t) AS digest FROM t WHERE t <> ''{_LONG}),
d AS (SELECT doc_id, {_LINES} AS l FROM documents),
s AS (SELECT doc_id, sha256(array_to_string(l, ' ')) AS whole, l, len(l) AS n FROM d),
p AS (SELECT doc_id, whole, l, unnest(range(1, n + 1)) AS i FROM s),
q AS (SELECT p.doc_id, p.whole, string_split(array_to_string(p.l[p.i:], ' '), ' ') AS w, list_transform(p.l[p.i:], lambda x: len(string_split(x, ' '))) AS sizes, string_split(p.l[p.i], ' ')[1] AS first FROM p),
c AS (SELECT q.doc_id, q.whole, k.license, k.digest, q.w, k.n, sizes FROM q JOIN k ON k.first = q.first WHERE len(q.w) >= k.n),
h AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses,
  coalesce(array_to_string(list_sort(list_distinct(list(license) FILTER (WHERE digest = whole))), ','), '') AS whole_license
  FROM c WHERE sha256(array_to_string(w[1:n], ' ')) = digest AND list_contains(list_transform(range(1, len(sizes) + 1), lambda j: list_sum(sizes[1:j])), n) GROUP BY doc_id)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_lines, s.whole AS text_digest, coalesce(h.whole_license, '') AS whole_license, coalesce(h.licenses, '') AS licenses
FROM s LEFT JOIN h ON h.doc_id = s.doc_id
"""

_URL_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_HOST = _lower(f"regexp_extract({_URL_REST}, '^[^/?#]*', 0)")
OP6 = f"""
WITH l AS (SELECT page_id, coalesce({_HOST}, '') AS host,
  list_filter(list_transform(string_split_regex(coalesce(html, ''), {_quoted(line_dedup.BREAKS)}), lambda x: trim(x)), lambda x: x <> '') AS lines FROM pages),
t AS (SELECT host, count(*) AS pages FROM l WHERE host <> '' GROUP BY host),
o AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l WHERE host <> '') GROUP BY host, line),
b AS (SELECT o.host, list(o.line) AS often FROM o JOIN t ON o.host = t.host WHERE o.n > 1 AND o.n > t.pages * {line_dedup.RATIO} GROUP BY o.host),
k AS (SELECT l.*, CASE WHEN b.often IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(b.often, x)) END AS kept FROM l LEFT JOIN b ON l.host = b.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
"""

_PATH = f"regexp_extract({_URL_REST}, '^[^/?#]*([^?#]*)', 1)"
_FITS = [(v, r, f"(host = {_quoted(r.partition('/')[0])} OR ends_with(host, {_quoted('.' + r.partition('/')[0])}))", f"starts_with(path, {_quoted('/' + r.partition('/')[2])})") for v, r in sorted(url_filter.RULES, key=lambda r: (-len(r[1]), r[1]))]
_PLAIN = "(len(parts) < 2 OR regexp_matches(name, '^[0-9.]+$') OR ends_with(name, '.') OR starts_with(name, '['))"
_SUFFIXED = f"len(parts) > 2 AND parts[-2] || '.' || parts[-1] IN ({', '.join(map(_quoted, url_filter.SUFFIXES))})"


def _strength(groups: str) -> str:
    return f"(SELECT coalesce(greatest(1.0e0, least(1000.0e0, CASE WHEN v - p * (1 - p) * i > 1e-9 THEN p * (1 - p) / (v - p * (1 - p) * i) - 1 ELSE 1000.0e0 END)), 1000.0e0) FROM (SELECT sum(bad) / sum(n) AS p, var_samp(bad / n) AS v, avg(1 / n) AS i FROM {groups} WHERE n > 0))"


OP10 = f"""
WITH u AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages),
r AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, CASE {" ".join(f"WHEN {h} AND {p} THEN {_quoted(r)}" for _, r, h, p in _FITS)} END AS rule,
  CASE {" ".join(f"WHEN {h} AND {p} THEN {_quoted(v)}" for v, _, h, p in _FITS)} END AS said, {" OR ".join(h for _, _, h, _ in _FITS)} AS reviewed FROM u),
h AS (SELECT name, string_split(name, '.') AS parts, CAST(count(*) FILTER (WHERE reviewed) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE reviewed AND said = 'block') AS DOUBLE) AS bad FROM r GROUP BY name),
g AS (SELECT name, n, bad, CASE WHEN {_PLAIN} THEN name WHEN {_SUFFIXED} THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
  CASE WHEN {_PLAIN} THEN name WHEN {_SUFFIXED} THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix FROM h),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM g GROUP BY domain, suffix), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
m AS (SELECT {_strength("s")} AS ms, {_strength("d")} AS md, {_strength("g")} AS mh, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM s) AS p),
a AS (SELECT suffix, (ms * p + bad) / (ms + n) AS x FROM s, m), b AS (SELECT domain, d.suffix, (md * a.x + bad) / (md + n) AS x FROM d JOIN a ON a.suffix = d.suffix, m),
c AS (SELECT g.name, (mh * b.x + bad) / (mh + n) AS rate, mh + n AS w FROM g JOIN b ON b.domain = g.domain AND b.suffix = g.suffix, m),
f AS (SELECT name, rate, rate - {url_filter.Z} * sqrt(rate * (1 - rate) / (w + 1)) AS bound FROM c)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bound > {url_filter.MOST_BAD} THEN 'block' ELSE 'allow' END) AS verdict, round(rate, 6) AS bad_rate, round(bound, 6) AS bound
FROM r JOIN f ON f.name = r.name
"""

_OP7_WORDS = rf"regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_OP7_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
j AS (SELECT item_id, w, least({decontaminate.WINDOW}, len(w)) AS n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM j)),
d AS (SELECT doc_id, {_OP7_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM j) WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.s, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, array_to_string(list_sort(list(item_id)), ',') AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


#: The table of CRC-32, made by its rule, and the checksum of a list of bytes.
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t"


def _crc(data: str) -> str:
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda a, b: xor(a // 256, t[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295)"


def _bytes(text: str) -> str:
    """UTF-8 bytes of text below U+0100."""
    return f"flatten(list_transform(list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda u: CASE WHEN u < 128 THEN [u] ELSE [194 + (u - 128) // 64, 128 + u % 64] END))"


_DOC_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(**changed: str) -> str:
    text = {c: f"CAST({changed.get(c, c)} AS VARCHAR)" for c in _DOC_FIELDS}
    return "sha256(" + " || ".join(f"coalesce(CAST(octet_length(encode({x})) AS VARCHAR) || ':' || {x}, '-')" for x in text.values()) + ")"


def _tree(name: str, depth: int) -> str:
    """Levels name0, ... of (g, i, h), each with what stands before and after a node in its run, and how many nodes there are."""
    out = ""
    for k in range(depth + 1):
        rows = f"{name}_leaves" if k == 0 else f"(SELECT g, i // {merkle.FANOUT} AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k - 1} GROUP BY g, i // {merkle.FANOUT})"
        out += f"""{name}{k} AS MATERIALIZED (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n, coalesce(string_agg(h, '') OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
 coalesce(string_agg(h, '') OVER (u ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {rows} WINDOW u AS (PARTITION BY g, i // {merkle.FANOUT} ORDER BY i)), """
    return out


def _climb(base: str, g: str, i: str, name: str, depth: int) -> str:
    """base (g, i, folded, path) -> the same after all levels of a tree."""
    for k in range(depth):
        base = f"(SELECT c.* REPLACE (CASE WHEN n = 1 THEN folded ELSE sha256(a || folded || b) END AS folded, path || a || b AS path, c.{i} // {merkle.FANOUT} AS {i}) FROM {base} c JOIN {name}{k} t ON t.g = c.{g} AND t.i = c.{i})"
    return base


#: Deep enough for 16**6 rows of a source and 16**3 sources.
_DEEP, _TOP = 6, 3
OP11 = f"""
WITH crc AS MATERIALIZED ({_CRC_TABLE}),
d AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {_leaf()} AS h, CASE WHEN {_crc(_bytes("CAST(doc_id AS VARCHAR)"))} % 5 = 0 THEN {_leaf(text=_lower("text"))} ELSE {_leaf()} END AS now FROM documents, crc),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
s_leaves AS (SELECT g, i, h FROM l), {_tree("s", _DEEP)}r_leaves AS (SELECT 0 AS g, g AS i, h FROM s{_DEEP}), {_tree("r", _TOP)}
c AS (SELECT *, 0 AS z, g AS place FROM {_climb("(SELECT doc_id, h AS leaf, g, i, now AS folded, '' AS path FROM l)", "g", "i", "s", _DEEP)}),
e AS {_climb("c", "z", "place", "r", _TOP)}
SELECT doc_id, leaf, s{_DEEP}.h AS subroot, r{_TOP}.h AS root, sha256(path) AS proof_sha256, folded AS folded_root, folded = r{_TOP}.h AS verified
FROM e JOIN s{_DEEP} ON s{_DEEP}.g = e.g, r{_TOP}
"""

_RUNS = "regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')"
OP12 = f"""
WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}),
runs AS (SELECT doc_id, {_lower("run")} AS run, count(*) AS n FROM (SELECT doc_id, unnest({_RUNS}) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, {_crc(_bytes("doc_id || ':' || run"))} AS h FROM runs, crc),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, n FROM hashed)
  WHERE len(word) >= {variants.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {variants.LEAST_COUNT}),
k AS MATERIALIZED (SELECT word, n, i, word[:i] || word[i + 2:] AS key FROM (SELECT word, n, unnest(range(len(word))) AS i FROM w)),
longer AS (SELECT DISTINCT k.word, k.n, w.word AS other, w.n AS other_n FROM k JOIN w ON k.key = w.word),
p AS MATERIALIZED (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM k a JOIN k b ON a.key = b.key AND a.i = b.i AND a.word <> b.word UNION ALL SELECT * FROM longer UNION ALL SELECT other, other_n, word, n FROM longer),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN other_n >= {variants.FORM_RATIO} * w.n THEN other END AS form, CASE WHEN other_n >= {variants.FORM_RATIO} * w.n THEN other_n END AS form_n FROM w LEFT JOIN near ON near.word = w.word),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends ON ends.word = f.word
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": OP2, "op5_licenses": OP5, "op6_line_dedup": OP6, "op7_decontamination": OP7, "op8_top_k": OP8, "op10_url_filter": OP10, "op11_merkle_manifest": OP11, "op12_spelling_variants": OP12}
