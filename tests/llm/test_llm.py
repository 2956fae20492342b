"""The training-data operators on small tables: brute force, edge rows, round trips, held-out accuracy."""

import collections
import hashlib
import importlib
import math
import re
import zlib

import pytest

from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"
BASE = "the quick brown fox jumps over a lazy dog near the old river bank while birds sing songs of spring and summer rain".split()


def words_of(i, n=60):
    return " ".join(f"w{(i * 7919 + k * 104729) % 9973}" for k in range(n))


def edge_rows():
    near = words_of(1).split()
    rows = [(1, " ".join(near)), (2, " ".join(near)), (3, " ".join(near[:-1] + ["other"])), (4, words_of(2)), (5, None), (6, ""), (7, "  \n\t "),
            (8, "one two"), (9, "One TWO"), (10, None), (None, words_of(3)), (11, words_of(4, 9000)), (4, words_of(2)),
            (12, "mail bob.x@mail.example.com or 10.0.0.1, card 4111 1111 1111 1111, call +1 (058) 555-3468."),
            (13, "Ünïcode 😀 " + words_of(5))]
    return [(i, t, None if i == 4 else "en", None if i == 8 else "src0", None, 0.5, "k") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def raw_words(t):
    return (t or "").encode().lower().split()


def shingles(t, n):
    w = raw_words(t)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                top[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((str(rows[k][0]), len(sets[k]), str(rows[k][0] if not sets[k] else least.get(root(k)))) for k in range(len(rows)))


def test_neardup_against_brute_force(spark, docs, empty):
    from retainlab.llm.op1_minhash_neardup import near_duplicates
    edge = [(r.doc_id, r.text) for r in docs.collect()]
    chain = [(100 + k, " ".join(words_of(50).split()[:60 - 2 * k] + words_of(60 + k).split()[:2 * k])) for k in range(12)]
    near = spark.createDataFrame(edge + chain, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_duplicates(near, 3, 85, 100).collect())
    assert got == brute_components(edge + chain, 3, 85, 100)
    assert near_duplicates(empty).count() == 0


def test_index_covers_threshold():
    from retainlab.llm.op1_minhash_neardup import chunks_for
    assert chunks_for(85, 100) < chunks_for(80, 100)
    with pytest.raises(ValueError):
        chunks_for(1, 100)


def test_components(spark):
    from retainlab.llm.components import components
    path = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 200: 100}


def test_preferences(spark):
    from retainlab.llm import op2_preference_format as op
    cols = "conv_id long, turn long, role string, text string, status string"
    a = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "good", "x"), (2, 0, "user", "q", "x"), (3, 0, None, None, "x"), (4, None, "user", "é😀", "x"),
         (4, 1, "assistant", "a", "x")]
    b = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "bad", "x"), (2, 0, "user", "q", "x"), (4, None, "user", "é😀", "x")]
    out = {r.id: r for r in op.format_preferences(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols)).collect()}
    assert out[1].prompt == "<|user|>\nhi<|end|>\n" and out[1].status == "pair" and out[1].n_prompt_turns == 1
    assert out[2].status == "identical" and out[2].chosen == "" and out[3].status == "prefix" and out[4].status == "prefix"
    for side in ("chosen", "rejected"):
        whole = out[1].prompt + out[1][side]
        spans = [whole[s.start:s.end] for s in out[1][side + "_mask"]]
        assert spans == [{"chosen": "good", "rejected": "bad"}[side] + "<|end|>"]
    assert op.format_preferences(spark.createDataFrame([], cols), spark.createDataFrame([], cols)).count() == 0


def accuracy(rows, label):
    rows = [r for r in rows if r.held_out]
    return sum(r.predicted == r[label] for r in rows) / len(rows), rows


@pytest.mark.parametrize("name, label, least", [("op3_toxicity_mil", "toxic", 0.93), ("op9_quality_nbsvm", "quality", 0.97)])
def test_classifiers_on_held_out(spark, docs, empty, name, label, least):
    op = importlib.import_module(f"retainlab.llm.{name}")
    sf = "/root/testdata/sf0.1"
    own, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = op.train(own, labels, max_fit=3000)
    share, rows = accuracy(op.score(own, model).join(labels, "doc_id").collect(), label)
    assert share >= least
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = op.score(docs, model).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r.score <= 1 for r in out)
    assert op.score(empty, model).count() == 0
    none = op.train(docs, spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int"))
    assert {round(r.score, 6) for r in op.score(docs.where("length(text) < 4"), none).collect()} == {0.5}


def test_training_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    from retainlab.llm import labelled
    kept = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    hot = kept[0]
    rows = [(i, words_of(i)) for i in range(60)] + [(hot, words_of(hot))] * 3000 + [(hot, words_of(500 + k)) for k in range(20)]
    rows += [(kept[1], "x" * 3000), (kept[2], None), (None, "no id")]
    labels = [(i, i % 2) for i in range(60)] + [(hot, 1), (None, 1), (kept[3], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    sample = lambda **bound: labelled.training_sample(docs, marks, "quality", **bound).collect()
    monkeypatch.setattr(labelled, "MAX_TEXT_BYTES", 2000)
    whole = sample()
    assert len(whole) == len({r._o for r in whole}) == len(kept) and {r.text for r in whole} <= {t or "" for _, t in rows}
    assert not any(len(r.text) > 2000 for r in whole) and sorted(whole) == sorted(sample())
    size = {r._o: len(r.text.encode()) for r in whole}
    part = sample(max_bytes=sum(size.values()) // 2)
    assert 0 < len(part) < len(whole) and sum(len(r.text.encode()) for r in part) <= sum(size.values()) // 2
    assert {r._o for r in part} == set(sorted(size)[:len(part)])  # the first ones by the hash of the id
    assert len(sample(max_fit=7)) == 7


def test_toxicity_locates_the_sentence(spark):
    from retainlab.llm import op3_toxicity_mil as op
    rows = [(k, f"{words_of(k, 20)}. " + ("you vile fool. " if k % 2 else "what a day. ") + words_of(k + 500, 20) + ".") for k in range(1, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 400)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in op.score(docs, op.train(docs, labels)).collect()}
    assert sum(out[k].predicted == k % 2 for k, _ in rows) > 390
    assert sum(rows[k - 1][1].encode()[out[k].worst_start:out[k].worst_end] == b"you vile fool" for k in range(1, 400, 2)) > 180


def test_toxicity_of_rare_words():
    import numpy as np

    from retainlab.llm import op3_toxicity_mil as op

    def bag(k, word):
        raw = np.frombuffer(f"{words_of(k, 20)}. you {word} {words_of(k + 9, 5)}. {words_of(k + 5000, 20)}.".encode(), np.uint8)
        return op.sentences(raw, np.array([0, len(raw)]))

    seen = {"vile": 5, "nasty": 8, "foul": 12, "rotten": 40}
    toxic = [bag(100 * i + k, w) for i, (w, n) in enumerate(seen.items()) for k in range(n)]
    clean = [bag(1000 + k, f"good{k % 40}") for k in range(800)]
    weights = op.fit_bags(np.array([1] * len(toxic) + [0] * len(clean)), toxic + clean)

    def flagged(b):
        p = op.sigmoid(np.bincount(b["row"], weights[b["f"]], len(b["doc"])) + weights[-1])
        return op.noisy_or(p, b["doc"], 1)[0] >= 0.5

    for word in seen:  # on documents that the fit has not seen
        assert sum(flagged(bag(3000 + k, word)) for k in range(20)) >= 18, word
    assert sum(flagged(bag(3000 + k, f"good{k % 40}")) for k in range(200)) <= 2


def test_language_id(spark, empty):
    from retainlab.llm import op4_language_id as op
    sf = "/root/testdata/sf0.01"
    pages, docs = spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    urls = {r.page_id: re.search(r"/([a-z]{2})/", r.url) for r in pages.collect()}
    out = op.identify(pages, docs).collect()
    assert len(out) == pages.count()
    judged = [(urls[r.page_id][1], r.lang) for r in out if urls[r.page_id]]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "http://a.de/", "", "x"), (None, "not a url", "<html lang=de><p>der die das", "x"), (2, "http://a.de/", "", "x")],
                                "page_id long, url string, html string, lang string")
    assert op.identify(odd, docs).count() == 4 and op.identify(odd.limit(0), docs).count() == 0
    assert op.identify(odd, empty).count() == 4


def test_ppm_against_brute_force(spark, docs, empty):
    from retainlab.llm.op5_ppm import ORDER, score
    rows = [(r.doc_id, r.text or "") for r in docs.collect() if len(r.text or "") < 2000]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    words, ctx = collections.Counter(), collections.defaultdict(collections.Counter)
    for (_, t), h in zip(rows, held):
        s = [0xFE] * ORDER + list(t.encode()) + [0xFF]
        if not h:
            words.update(raw_words(t) + ["end"])
            for i in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    ctx[tuple(s[i - k:i])][s[i]] += 1

    def code(s, i):
        gone, out = set(), 0.0
        for k in range(ORDER, -1, -1):
            seen = ctx.get(tuple(s[i - k:i]))
            if seen:
                rest = {x: n for x, n in seen.items() if x not in gone}
                total = sum(rest.values()) + len(rest)
                if s[i] in rest:
                    return out + math.log10(rest[s[i]] / total)
                out += math.log10(len(rest) / total) if total else 0.0
                gone |= set(seen)
        return out - math.log10(255 - len(gone))

    n, v = sum(words.values()), len(words)
    want = []
    for (i, t), h in zip(rows, held):
        s, tok = [0xFE] * ORDER + list(t.encode()) + [0xFF], raw_words(t) + ["end"]
        want.append((str(i), h, len(tok), sum(words[w] > 0 for w in tok), n, round(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tok), 6),
                     round(sum(code(s, k) for k in range(ORDER, len(s))), 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in score(own).collect()]
    assert sorted(got) == sorted(want)
    assert score(empty).count() == 0


def test_host_rules(spark, docs, empty):
    from retainlab.llm import op6_host_rules as op
    out = op.host_filter(docs).collect()
    assert len(out) == len(edge_rows()) and op.host_filter(empty).count() == 0
    assert {r.n_words for r in out if r.doc_id in (5, 6, 7, 10)} == {0}
    bad = " ".join(["spam"] * 40)
    rows = [(k, bad if k < 30 else words_of(k), "bad" if k < 40 else "good") for k in range(80)]
    got = {r.doc_id: r for r in op.host_filter(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[k].kept for k in range(40)) and all(got[k].kept for k in range(40, 80))
    line = "a line\na line\n \n \nb"
    one = op.host_filter(spark.createDataFrame([(1, line, None)], "doc_id long, text string, source string")).first()
    assert one.n_dup_lines == 1 and one.n_repeat_words == 0


def test_host_outlier_decides(spark):
    from retainlab.llm import op6_host_rules as op
    bad = " ".join(["spam"] * 40)
    # 20 hosts of 100 rows fail 3 times, one fails 35 times, one of 4 rows fails twice: too few to tell
    hosts = {f"h{k}": (100, 3) for k in range(20)} | {"outlier": (100, 35), "small": (4, 2)}
    rows = [(bad if j < failed else words_of(j), h) for h, (n, failed) in hosts.items() for j in range(n)]
    docs = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(rows)], "doc_id long, text string, source string")
    verdicts = {r.host: r for r in op.host_verdicts(op.document_rules(docs)).collect()}
    rates = [f / n for n, f in hosts.values()]
    m = sum(rates) / len(rates)
    v = sum((x - m) ** 2 for x in rates) / len(rates)
    strength = min(1000.0, max(2.0, m * (1 - m) / v - 1))
    for h, (n, failed) in hosts.items():
        post = (failed + m * strength) / (n + strength)
        floor = post - 1.645 * math.sqrt(post * (1 - post) / (n + strength + 1))
        assert math.isclose(verdicts[h].host_rate, post) and math.isclose(verdicts[h].host_floor, floor)
        assert verdicts[h].host_kept == (post <= 0.5 and floor <= m + 0.1) == (h != "outlier")
    out = op.host_filter(docs).collect()
    assert sum(not r.kept and not r.base_failed for r in out) == 65  # passed the rules, refused by the host
    assert all(r.kept for r in op.host_filter(docs, margin=1.0).collect() if not r.base_failed)


def test_decontamination(spark, docs, empty):
    from retainlab.llm import op7_decontaminate as op
    item = words_of(77, 14)
    bench = spark.createDataFrame([(1, item), (1, item), (None, words_of(78, 12)), (2, "Only Three words"), (3, None), (4, "...")], "item_id long, text string")
    rows = [(1, f"before {item.upper()} after"), (2, "x only, THREE-words y"), (3, words_of(78, 12)), (4, words_of(79)), (5, None)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1 << 20, 1 << 11):  # one broadcast, several shards
        out = {r.doc_id: r for r in op.report(op.scan(own, bench, max_broadcast=limit)).collect()}
        assert [out[k].n_hit for k in range(1, 6)] == [14, 3, 12, 0, 0] and [out[k].n_items for k in range(1, 6)] == [1, 1, 0, 0, 0]
        assert out[1].items_sha256 == hashlib.sha256(b"1").hexdigest() and out[5].n_words == 0
    clean = {r.doc_id: r.text for r in op.remove_spans(own, bench).collect()}
    assert clean == {1: "before  after", 2: "x  y", 4: words_of(79), 5: None}
    assert op.report(op.scan(docs, bench.limit(0))).where("contaminated").count() == 0 and op.scan(empty, bench).count() == 0


def test_decontamination_by_shard_equals_one_broadcast(spark):
    from retainlab.llm import op7_decontaminate as op
    items = [words_of(300 + k, 14) for k in range(12)]
    bench = spark.createDataFrame([(str(k), t) for k, t in enumerate(items)], "item_id string, text string")
    rows = [(k, t, "x") for k, t in enumerate(items)]
    rows += [(100 + k, f"start {t} -- middle {items[(k + 5) % 12]} end", None) for k, t in enumerate(items)]
    # cutting one passage joins the halves of another
    rows += [(200 + k, " ".join(t.split()[:7] + [items[(k + 3) % 12]] + t.split()[7:]) + " rest", "y") for k, t in enumerate(items)]
    rows += [(300, None, None), (301, "", None), (302, words_of(9), "z"), (302, words_of(9), "z"), (200, rows[24][1], "y")]
    own = spark.createDataFrame(rows, "doc_id long, text string, `_key` string")

    def result(limit):
        return collections.Counter(map(tuple, op.remove_spans(own, bench, max_broadcast=limit).collect()))

    whole = result(1 << 26)
    assert whole[(200, " rest", "y")] == 2 and not any(i < 100 for i, _, _ in whole)
    assert result(1 << 11) == whole


def plain_spans(t):
    def luhn(d):
        return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, lo, hi in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if lo <= len(d) <= hi and (kind == 3 or luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_pii_spans(spark, docs, empty):
    from retainlab.llm import op8_pii as op
    odd = ["a@b.com_x@c.org @@ z@y", "1.2.3.4.5.6.7.8 and 001.02.3.256 300.1.1.1", "4111111111111111 4111-1111-1111-1112", "+1 23 456 789 0 +12 (3)",
           "é😀 a.b@c.d.e 9.9.9.9", "x" * 3000 + "@", "1" * 3000, "a@b" + ".c" * 3000]
    own = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    found = op.find_spans(own, model=("0.0D", {})).collect()
    text = [(str(r.doc_id), r.text or "") for r in own.collect()]
    want = sorted((i, plain_spans(t)) for i, t in text)
    assert sorted((str(r.doc_id), [(s.start, s.kind, s.end) for s in r.base]) for r in found) == want
    clean = {r.doc_id: r.text for r in op.redact(docs, ("0.0D", {})).collect()}
    assert clean[12] == "mail [EMAIL] or [IP], card [CARD], call [PHONE]." and clean[5] is None
    assert op.find_spans(empty).count() == 0 and op.find_spans(docs).count() == len(edge_rows())
    # a model adds spans apart from the base ones, never removes any
    all_in = op.find_spans(own, model=("1.0D", {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.0})).collect()
    assert any(r.base for r in all_in) and any(len(r.spans) > len(r.base) for r in all_in)
    for r in all_in:
        base, spans = ({(s.start, s.kind, s.end) for s in part} for part in (r.base, r.spans))
        assert base <= spans
        assert not any(a < d and c < b for a, _, b in spans - base for c, _, d in spans if (a, b) != (c, d))


def test_pii_learns_forms_beyond_the_base_rules(spark):
    from retainlab.llm import op8_pii as op
    rows = [(k, f"{words_of(k, 6)} mail to u{k}.x@host{k % 90}.example.org or {k % 250}.1.2.{k % 9} now {words_of(k + 3, 4)}") for k in range(400)]
    model = op.train(spark.createDataFrame(rows, "_id long, _text string"))
    odd = [(1, "you can reach bob.x (at) mail dot org today", "email:14:37"), (2, "host 2001:0db8:85a3:0001:0002:8a2e:0370:7334 is up", "ip:5:44"),
           (3, "on 2024-03-17 10:45 and order 48213907345 we met", ""), (4, None, ""), (5, "write to a@b.com", "email:9:16")]
    own = spark.createDataFrame([(i, t) for i, t, _ in odd], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in op.report(op.find_spans(own, model=model)).collect()}
    assert got == {i: w for i, _, w in odd}


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from retainlab.llm import op10_bestfit_pack as op
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = docs.select("doc_id", "text").union(spark.createDataFrame(
        [(900, "a  b \n c<|endoftext|> d\x1c e\xa0 f"), (901, "tail "), (902, " \n"), (903, "it's 12,345 x　y")], "doc_id long, text string"))
    rows = op.pack(special).collect()
    ids = collections.Counter()
    import numpy as np
    for r in special.collect():
        t = np.array(exact.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        first = (len(t) - 1) % 2048 + 1
        cuts = [0, *range(first, len(t) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            ids[(r.doc_id, k, a, b - a, zlib.crc32(t[a:b].tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == ids
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert op.pack(empty).count() == 0
    hist = {7: 5, 5: 5, 3: 5, 10: 2, 1: 3}
    done = op.plan(hist, 10)
    assert sum(t for _, t in done) == -(-sum(k * v for k, v in hist.items()) // 10)


def test_packing_search_is_optimal():
    import random

    from retainlab.llm import op10_bestfit_pack as op

    def fewest(items, capacity):
        best = len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1:]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best

    rng = random.Random(3)
    cases = [([47, 12, 23, 22, 29, 55, 34, 29, 43], 100)]  # greedy fillings take 4
    cases += [([rng.randint(c // 10, c * 2 // 3) for _ in range(rng.randint(5, 10))], c) for c in [20, 30, 50, 100] * 20]
    for items, capacity in cases:
        items = sorted(items, reverse=True)
        done, bound, proven = op.search(dict(collections.Counter(items)), capacity)
        placed = collections.Counter(x for filling, times in done for x in filling * times)
        assert placed == collections.Counter(items) and all(sum(f) <= capacity for f, _ in done)
        assert proven and bound <= sum(t for _, t in op.plan(dict(collections.Counter(items)), capacity)) == fewest(items, capacity)
    many = {x: 3 for x in range(60, 700, 7)}
    done, bound, proven = op.search(many, 2048, max_nodes=50)  # a spent budget still places everything
    assert collections.Counter({x: sum(f.count(x) * t for f, t in done) for x in many}) == collections.Counter(many)


def test_pipeline(spark):
    import corpus_pipeline as cp
    stages = dict(cp.STAGES)
    src = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    one = stages["quality_classifier"](spark, src, SF_SMALL)
    assert one.columns == src.columns
    two = stages["minhash_neardup"](spark, src, SF_SMALL)
    rows = [(r.doc_id, r.text) for r in src.collect()]
    assert sorted(str(r.doc_id) for r in two.collect()) == sorted(i for i, _, c in brute_components(rows, 5, 80, 100) if i == c)
    three = stages["benchmark_decontamination"](spark, src, SF_SMALL)
    from retainlab.llm import op7_decontaminate as op7
    assert op7.report(op7.scan(three, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet"))).where("contaminated").count() == 0
    four = stages["pii_redaction"](spark, src, SF_SMALL)
    assert four.columns == src.columns and not any(plain_spans(r.text) for r in four.collect())
    out = cp.run(spark, SF_SMALL)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_pii_trains_on_every_document(spark):
    """More documents than the former sample of 20,000: each one's spans count."""
    from retainlab.llm import op8_pii as op
    seen = []
    keep, op.cut = op.cut, lambda df: (seen.append(keep(df)), seen[-1])[1]
    try:
        op.train(spark.range(22_000).selectExpr("id AS _id", "concat('mail a', id, '@b.org now') AS _text"))
    finally:
        op.cut = keep
    assert seen[0].count() == 22_000
    assert "_text" not in seen[0].columns
