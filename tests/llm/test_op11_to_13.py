"""Spelling variants, fill-in-middle and SimHash near-dedup against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_SMALL

EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two"), (5, "One two"), (None, "null id text here"),
         (6, "a" * 70_000), (7, "word and " * 30_000), (8, "naïve café ÀÉ × ÷ 日本 ünïcode"), (9, "<P> marks <M>"),
         (10, "line\r\nbreak\x0bvt"), (11, "1234567890" * 40)]


def _docs(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("n", F.lit("x")).withColumn("word", F.lit(1)).withColumn("fp", F.lit(None).cast("string")) \
        .withColumn("form", F.lit(2)).withColumn("_h1", F.lit("y"))


def _sample(spark):
    return [(r["doc_id"], r["text"]) for r in
            spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]


# ------------------------------------------------------------------ spelling variants

def _one_edit(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return any(x == y[:i] + y[i + 1:] for i in range(len(y)))


def _brute_counts(rows, spoil=97):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % spoil == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def _brute_variants(words):
    near = {w: [] for w in words}
    gaps = {}
    for w in words:  # words one edit apart share the word with one character left out, or one is the other's remainder
        for k in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            gaps.setdefault(k, set()).add(w)
    pairs = {p for g in gaps.values() for p in itertools.combinations(sorted(g), 2)}
    for x, y in pairs:
        if _one_edit(x, y):
            near[x].append(y)
            near[y].append(x)
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        out[w] = best if best is not None and words[best] >= 2 * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while out[root] is not None:
            root = out[root]
        rows.add((w, out[w], root, n, len(near[w]), words.get(out[w])))
    return rows


def _variants(found):
    return {tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_spelling_variants_equal_brute_force(spark):
    from retainlab.llm import op11_spelling_variants as op

    rows = _sample(spark) + EDGES
    got = op.grouped(_docs(spark, rows))
    assert _variants(got) == _brute_variants(_brute_counts(rows))
    assert got.count() == len(_brute_counts(rows))


@pytest.mark.parametrize("pairs", [0, 40])
def test_near_words_do_not_depend_on_the_group_bound(spark, pairs):
    """Hot chunks: one stem and one ending held by most words; every bound gives all pairs."""
    from retainlab.llm import op11_spelling_variants as op

    rng = random.Random(3)
    words = {"prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) for _ in range(150)}
    words |= {"".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) + "endings" for _ in range(150)}
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "aabaa", "a", "ab", "é" * 100, "é" * 101, "é" * 99 + "a"}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    got = {tuple(sorted(r)) for r in op.near_words(df, pairs).collect()}
    assert got == {p for p in itertools.combinations(sorted(words), 2) if _one_edit(*p)}


def test_spelling_chain_ties_and_empty(spark):
    from retainlab.llm import op11_spelling_variants as op

    text = " ".join(["wordaa"] * 24 + ["wordab"] * 24 + ["wordac"] * 12 + ["wordbc"] * 6 + ["xordbc"] * 3)
    got = {r["word"]: r for r in op.grouped(_docs(spark, [(1, text)]), spoil=1 << 40).collect()}
    assert got["wordac"]["form"] == "wordaa"  # tie of 24: the smallest word
    assert got["xordbc"]["form"] == "wordbc" and got["wordbc"]["form"] == "wordac"
    assert got["xordbc"]["root"] == "wordaa" and got["wordaa"]["root"] == "wordaa" and got["wordaa"]["form"] is None
    none = op.grouped(_docs(spark, []))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


# ------------------------------------------------------------------ fill-in-middle

def _brute_fim(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", text, None, None
    if h[3] % 100 < 20:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_fill_in_middle_equals_brute_force_and_restores(spark):
    from retainlab.llm import op12_fill_in_middle as op

    rows = _sample(spark) + EDGES + [(k, f"< <P{k} S> <<> é{k}\n" * 3) for k in range(100, 200)]
    done = op.fill_in_middle(_docs(spark, rows))
    got = done.select("doc_id", "n", "form", "output", "prefix_chars", "middle_chars", op.restore().alias("back")).collect()
    want = Counter((i, *_brute_fim(i, t), t or "") for i, t in rows)
    assert Counter(tuple(r) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert op.fill_in_middle(_docs(spark, [])).count() == 0


def test_unit_ends_do_not_depend_on_the_piece():
    from retainlab.llm.op12_fill_in_middle import unit_ends

    for text in ("", "abc", "ab cd  é1", "x" * 50 + " " + "y" * 50, "12345", "日本a"):
        whole = unit_ends(text).tolist()
        assert whole == [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]
        for piece in (1, 2, 7):
            assert unit_ends(text, piece).tolist() == whole


# ------------------------------------------------------------------ SimHash

def _brute_fp(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    size = min(3, len(words))
    h = [xxhash.xxh64(b" ".join(words[i:i + size]), seed=42).intdigest() for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _brute_components(fps, radius=3):
    """Least id per fingerprint reachable through links; fps: (id, unsigned fingerprint)."""
    values = sorted({f for _, f in fps})
    top = {f: f for f in values}

    def root(f):
        while top[f] != f:
            f = top[f]
        return f

    arr = np.array(values, np.uint64)
    for i, f in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= radius):
            top[root(values[int(j)])] = root(f)
    least = {}
    for i, f in fps:
        r = root(f)
        least[r] = min(x for x in (least.get(r), i) if x is not None) if (i is not None or least.get(r) is not None) else None
    return {(i, f"{f:016x}", least[root(f)]) for i, f in fps}


def test_simhash_equals_brute_force(spark):
    from retainlab.llm import op13_simhash_neardup as op

    rows = _sample(spark) + EDGES
    got = op.digest(op.near_duplicates(_docs(spark, rows)))
    assert got.count() == len(rows)
    assert {tuple(r) for r in got.collect()} == _brute_components([(i, _brute_fp(t)) for i, t in rows])
    assert op.near_duplicates(_docs(spark, [])).count() == 0


def test_fingerprint_is_xxh64_as_spark_has_it(spark):
    text = "Seven words of this text give FIVE"
    from retainlab.llm.op13_simhash_neardup import fingerprint

    words = text.lower().split()
    df = spark.createDataFrame([(" ".join(words[i:i + 3]),) for i in range(len(words) - 2)], "s string")
    h = [r[0] & (1 << 64) - 1 for r in df.select(F.xxhash64("s")).collect()]
    assert fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius, hot", [(0, 4096), (1, 4096), (2, 5), (3, 4096), (3, 5)])
def test_links_connect_all_pairs_within_the_radius(spark, monkeypatch, radius, hot):
    """Chains and balls around centres of both parities, the extreme words among them; few and many words to a half."""
    from retainlab.llm import op13_simhash_neardup as op

    monkeypatch.setattr(op, "HOT", hot)
    from retainlab.llm.components import components

    rng = random.Random(radius)
    fps = {0, (1 << 64) - 1, 1 << 63, (1 << 63) - 1, 7, 7 << 33}
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(40):
            fps.add(f)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << b
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = op.links(df, radius)
    assert all(1 <= bin((a ^ b) & (1 << 64) - 1).count("1") <= radius
               for a, b in found.collect())
    got = {r["node"]: r["root"] for r in components(found).collect()}
    ids = {f: i for i, f in enumerate(sorted(fps))}
    want = {f: c for f, (_, _, c) in zip(sorted(fps), sorted(_brute_components([(ids[f], f) for f in fps], radius)))}
    classes, mine = {}, {}
    for f in fps:
        s = f - (1 << 64) if f >> 63 else f
        classes.setdefault(want[f], set()).add(f)
        mine.setdefault(got.get(s, s), set()).add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))
