"""Merkle manifest, spelling variants and packing against brute force, with nulls, repeats, long texts and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegrid.llm import merkle, packing, tokens, variants

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx string, row string, block string, word string, n string, key string"


def frame(spark, rows):
    """rows (doc_id, source, lang, n_chars, text), with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA).repartition(3)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


# Merkle manifest ---------------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    for nodes in tree[:-1]:
        a = i // 16 * 16
        yield "".join(nodes[a:i]), "".join(nodes[i + 1 : a + 16])
        i //= 16


def lower(text):
    return None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_proofs(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    groups = [sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, digest(r))) for s in sorted(by, key=lambda s: (s is not None, (s or "").encode()))]
    trees = [levels(list(map(digest, g))) for g in groups]
    top = levels([t[-1][0] for t in trees])
    for k, (group, tree) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(group):
            steps = [*siblings(tree, i), *siblings(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = digest((*r[:4], lower(r[4]))) if hit else digest(r)
            for before, after in steps:
                now = h(before + now + after)
            yield r[0], digest(r), tree[-1][0], top[-1][0], h("".join(a + b for a, b in steps)), now, now == top[-1][0]


MANY = [(i, f"s{i % 20}" if i % 3 else "hot", "en", i, f"Té {i} X") for i in range(640)]
ODD = [(None, None, "e", 1, ""), (None, None, "e", 1, ""), (5, "hot", None, None, None), (5, "hot", None, None, None), (7, "S", "", 0, "Long " * 50_000)]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(i, "a", "en", 3, f"Abc{i}") for i in range(17)], [(i, f"s{i}", "en", 3, "T") for i in range(18)], MANY + ODD], ids=["none", "one", "one source", "lone leaves", "many"])
def test_proofs(spark, rows):
    found = merkle.tampered_proofs(frame(spark, rows)).collect()
    assert ordered(map(tuple, found)) == ordered(brute_proofs(rows))


def test_manifest_is_kept(spark, tmp_path):
    built = merkle.build(frame(spark, MANY), path=f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    assert nodes.where("up_level is null").count() == 1 and nodes.count() == built.nodes.count()
    assert all(r.verified for r in merkle.proofs(built).collect())


# Spelling variants -------------------------------------------------------------------------------


def brute_words(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            x = 1 if i is None else zlib.crc32(f"{i}:{run}".encode())
            found[run if x % 31 else run[: x % len(run)] + run[x % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(rows):
    n = brute_words(rows)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f and n[f] >= 10 * n[w] else None for w, f in form.items()}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None


@pytest.mark.parametrize("most", [0, variants.MOST_PAIRS_A_ROW])
def test_variants(spark, monkeypatch, most):
    """With 0 every chunk that two words share is cut down to single code points."""
    monkeypatch.setattr(variants, "MOST_PAIRS_A_ROW", most)
    rng = random.Random(3)
    base = ["".join(rng.choice("abÉé") for _ in range(rng.randint(7, 12))) for _ in range(300)]
    base += [b[:-1] + c for b in base[:40] for c in "xyz"] + ["Zz" + b for b in base[:20]]
    rows = [(i if i % 9 else None, " ".join(rng.choice(base[:15] if rng.random() < 0.6 else base) for _ in range(200)) + ", " + "q" * 90 + "x" * (i % 2)) for i in range(30)]
    rows += [(1, None), (2, ""), (None, "shorts only"), (3, "Twice×it÷was twicexx Twicexx"), rows[4], (None, "q" * 50_000), (None, "chainaaa " * 200 + "chainaab " * 20 + "chainabb " * 2)]
    found = variants.grouped(frame(spark, [(i, None, None, None, t) for i, t in rows])).collect()
    expected = list(brute_groups(rows))
    assert ordered(map(tuple, found)) == ordered(expected)
    assert sum(r[4] for r in expected) > 100 and any(r[2] not in r[:2] for r in expected)


def test_variants_of_nothing(spark):
    assert variants.grouped(frame(spark, [])).collect() == []


# Packing -----------------------------------------------------------------------------------------
public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers(monkeypatch):
    monkeypatch.setattr(tokens, "STRETCH", 50)
    words, rng = tokens.WordIds(VOCABULARY), random.Random(1)
    odd = ["İstanbul", "Σας", "ΟΔΟΣ", "étude", "Å", "naïve", "it's", "IT'S", "1²3", "½", "\x85x", "a\x1cb", "<|endoftext|>", "<|endoftext|", "ªº", "ß", "ẞ", "×÷", "don't!'ll", "\t", "\n\n", "日本語", "😀👍🏽", "ﬁ", "x​y", "'S", "\x00", "Ä'ö", "_a_b", "́", "ÿŸ", " ", "\n", "abc", "Über"]
    for _ in range(1500):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 30)))
        assert words.ids(text) == np.array(words.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def whole(found):
    """Every sequence holds at most SIZE tokens, gapless from 0."""
    for _, rows in found.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        ends = rows.offset + rows.length
        assert rows.offset.iloc[0] == 0 and (rows.offset.to_numpy()[1:] == ends.to_numpy()[:-1]).all() and ends.max() <= packing.SIZE


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 64)  # several rounds
    monkeypatch.setattr(packing, "BLOCK_BINS", 8)
    rng = random.Random(4)
    texts = [None, "", "", *(" ".join(rng.choice(["one", "Two", "thrée"]) for _ in range(rng.choice([3, 90, 700, 1100, 2047, 2048, 5000]))) for _ in range(300))]
    rows = [(i if i % 50 else None, None, None, None, t) for i, t in enumerate(texts)] + [(1, None, None, None, texts[5])] * 2
    found = packing.packed(frame(spark, rows), VOCABULARY).toPandas()
    words, expected = tokens.WordIds(VOCABULARY), []
    for i, *_, text in rows:
        ids = words.ids(text or "") + bytes(4)
        expected += [(i, k, k * 2048, min(2048, len(ids) // 4 - k * 2048), zlib.crc32(ids[8192 * k : 8192 * (k + 1)])) for k in range(-(-len(ids) // 8192))]
    got = [tuple(None if v != v else int(v) for v in r) for r in found[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert ordered(got) == ordered(expected)
    whole(found)
    assert found.sequence_id.nunique() <= -(-found.length.sum() // packing.SIZE) * 1.03
    held = packing.sequences(frame(spark, rows), VOCABULARY).collect()
    assert sum(r.length for r in held) == found.length.sum() and all(len(r.ids) == 4 * r.length for r in held)
    assert packing.packed(frame(spark, []), VOCABULARY).collect() == []


def test_breeding_needs_fewer_bins_than_best_fit():
    rng = np.random.default_rng(2)
    threes = [(a, b, 2048 - a - b) for a, b in zip(rng.integers(760, 1000, 60), rng.integers(500, 540, 60), strict=True)]
    lengths = np.array(threes).ravel()
    plain = packing.first_packing(lengths, 2048)
    best = packing.bred(lengths, [], 2048, 1, False, 12, 300)[0]
    assert np.bincount(best, lengths).max() <= 2048 and best.max() < plain.max()


def test_crossover_keeps_whole_bins_and_every_piece():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 2048, 200)
    a, b = (packing.first_packing(lengths, 2048, rng) for _ in range(2))
    for _ in range(20):
        child = packing.crossed(lengths, a, b, 2048, rng)
        fill = np.bincount(child, lengths)
        assert (child >= 0).all() and fill.max() <= 2048 and (fill > 0).all()
        bins = {frozenset(np.flatnonzero(b == k)) for k in range(b.max() + 1)}
        assert sum(frozenset(np.flatnonzero(child == k)) in bins for k in range(child.max() + 1)) > 1
