"""Language identification of pages by Bayesian evidence fusion.

Evidence for each of the languages of the training documents:

* text: log likelihood of the visible text's byte trigrams (hashed), from counts over all
  training documents; tempered, because neighbouring trigrams are not independent;
* declared: P(lang attribute | language), the attribute of the ``html`` element;
* suffix: P(last label of the host | language);
* host: a prior smoothed hierarchically, host -> domain (last two labels) -> all pages,
  each level shrunk to the next with the weight of ``SHRINK`` pages.

The last three come from grouped aggregations of the text posteriors over all pages; a
page's own share is taken out again before its evidence is read (leave one out).

Languages are codes of two or three letters (``[a-z]{2,3}`` after lower-casing and cutting at ``-`` or ``_``), so the
broadcast text model has DIMS weights (64 KB) for each code found; more than ``MAX_LANGS`` codes are an error.

Edge cases: null or empty html has no text evidence; a missing declaration, host or suffix
counts as a value of its own; ties go to the first code; without training languages lang
and the probabilities are null; repeated rows count as often as they occur; an empty table
has no row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainlab.llm.runtime import cut, lean
from retainlab.llm.textwords import LOWER, U, column, mix, slices

BITS = 14
DIMS = 1 << BITS
TEMPER = 0.2
SHRINK = 5.0
SMOOTH = 0.5
#: most language codes of the broadcast text model (64 MB)
MAX_LANGS = 1000

_OPEN = re.compile(r"<(?:(script|style)\b|!--)?|&[#\w]+;", re.I)
_CLOSE = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "!--": re.compile("-->"), "": re.compile(">")}


def visible(html: str | None) -> str:
    """Text between the tags, without scripts, styles and comments.

    One pass from left to right: an end that is not found once is not looked for again, so unclosed markup stays linear.
    An unclosed script, style or comment is an ordinary tag; a ``<`` without a ``>`` behind it is text.
    """
    text, out, at, pos, gone = html or "", [], 0, 0, set()
    while m := _OPEN.search(text, pos):
        end = m.end() if text[m.start()] == "&" else -1
        if end < 0:
            kind = "!--" if m[0].endswith("--") else (m[1] or "").lower()
            for k, start in ((kind, m.end()), ("", m.start() + 1)):
                found = None if k in gone else _CLOSE[k].search(text, start)
                if found:
                    end = found.end()
                    break
                gone.add(k)
        if end < 0:
            pos = m.start() + 1
        else:
            out += [text[at:m.start()], " "]
            at = pos = end
    return "".join([*out, text[at:]])


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams inside each text (letters and non-ASCII bytes; all else is a blank) and their text."""
    b = LOWER[buf]
    b = np.where((b >= 0x80) | ((b >= 0x61) & (b <= 0x7A)), b, 0x20).astype(np.uint64)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = (doc[2:] == doc[:-2]) & ~((b[1:-1] == 0x20) & ((b[2:] == 0x20) | (b[:-2] == 0x20)))
    g = mix((b[:-2] << U(16) | b[1:-1] << U(8) | b[2:]) + U(1)) >> U(64 - BITS)
    return g[keep].astype(np.int64), doc[:-2][keep]


def code(col):
    c = F.regexp_extract(F.lower(F.col(col).cast("string")), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1)
    return F.when(c != "", c)


def train_text(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram probabilities, from all documents with a language code."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(column(batch, "lang").to_pylist(), object)
            for first, last, buf, off in slices(column(batch, "text")):
                g, doc = trigrams(buf, off)
                names, which = np.unique(lang[first:last].astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    total[name] = total.get(name, 0) + np.bincount(g[which[doc] == k], minlength=DIMS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at], pa.int64())],
                                             names=["lang", "gram", "n"])

    src = docs.select(code("`lang`").alias("lang"), F.col("`text`").alias("text")).where("lang IS NOT NULL")
    counts = cut(src.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    found = counts.select("lang").distinct().count()
    if found > MAX_LANGS:
        raise ValueError(f"{found} language codes, at most {MAX_LANGS}")
    rows = counts.collect()  # at most MAX_LANGS * DIMS
    langs = sorted({r["lang"] for r in rows})
    n = np.full((len(langs), DIMS), SMOOTH)
    at = {lang: i for i, lang in enumerate(langs)}
    for r in rows:
        n[at[r["lang"]], r["gram"]] += r["n"]
    return langs, np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(pages: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """page_id, declared, host, domain, suffix, ll (tempered log likelihoods) and p (posterior of the text alone)."""
    shared = pages.sparkSession.sparkContext.broadcast(logp)
    k = len(langs)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            texts = pa.array([visible(x) for x in column(batch, "html").to_pylist()], pa.string())
            for first, last, buf, off in slices(texts):
                g, doc = trigrams(buf, off)
                ll = np.stack([np.bincount(doc, table[i][g], last - first) for i in range(k)], axis=1) * TEMPER
                ll -= ll.max(axis=1, keepdims=True)
                p = np.exp(ll)
                p /= p.sum(axis=1, keepdims=True)
                keep = [column(batch, c).slice(first, last - first) for c in ("page_id", "declared", "host", "domain", "suffix")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(list(ll), pa.list_(pa.float64())), pa.array(list(p), pa.list_(pa.float64()))],
                                                 names=["page_id", "declared", "host", "domain", "suffix", "ll", "p"])

    host = F.lower(F.regexp_extract(F.coalesce(F.col("`url`"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    head = F.col("`html`").cast("string")
    attr = F.regexp_extract(head, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})(?![A-Za-z])", 1)
    src = pages.select(F.col("`page_id`").cast("long").alias("page_id"), F.lower(F.coalesce(attr, F.lit(""))).alias("declared"), host.alias("host"),
                       F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1).alias("domain"), F.regexp_extract(host, r"\.([^.]*)$", 1).alias("suffix"),
                       F.col("`html`").alias("html"))
    return src.mapInArrow(run, "page_id long, declared string, host string, domain string, suffix string, ll array<double>, p array<double>")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, suffix, text_lang, lang, probability, and each evidence's log weight for ``lang``."""
    langs, logp = train_text(docs)
    k = len(langs)
    schema = ("page_id long, host string, declared string, suffix string, text_lang string, lang string, probability double, "
              "log_text double, log_declared double, log_suffix double, log_host double")
    if not k:
        none = {"host": "string", "declared": "string", "suffix": "string", "text_lang": "string", "lang": "string", "probability": "double",
                "log_text": "double", "log_declared": "double", "log_suffix": "double", "log_host": "double"}
        return pages.select(F.col("`page_id`").cast("long").alias("page_id"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    seen = cut(text_evidence(pages, langs, logp))
    sums = F.array(*[F.sum(F.col("p")[i]) for i in range(k)])
    out = seen
    for key in ("host", "domain", "suffix", "declared"):  # partial sums before each shuffle; one row a key
        out = out.join(seen.groupBy(key).agg(sums.alias(f"n_{key}")), key)
    whole = seen.agg(sums.alias("n")).first()["n"] or [0.0] * k

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            def arr(name: str) -> np.ndarray:
                return np.array(column(batch, name).to_pylist(), float).reshape(batch.num_rows, k)
            p, ll = arr("p"), arr("ll")
            total = np.array(whole) - p + SMOOTH
            prior = total / total.sum(axis=1, keepdims=True)
            for level in ("n_domain", "n_host"):
                n = np.maximum(arr(level) - p, 0.0)
                prior = (n + SHRINK * prior) / (n.sum(axis=1, keepdims=True) + SHRINK)
            parts = [ll, *[np.log((np.maximum(arr(c) - p, 0.0) + SMOOTH) / (total + SMOOTH)) for c in ("n_declared", "n_suffix")], np.log(prior)]
            z = sum(parts)
            z -= z.max(axis=1, keepdims=True)
            post = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            best, at = post.argmax(axis=1), np.arange(batch.num_rows)
            names = np.array(langs, object)
            yield pa.RecordBatch.from_arrays(
                [*[column(batch, c) for c in ("page_id", "host", "declared", "suffix")], pa.array(names[p.argmax(axis=1)], pa.string()),
                 pa.array(names[best], pa.string()), pa.array(post[at, best]), *[pa.array(x[at, best]) for x in parts]],
                names=[f.split()[0] for f in schema.split(", ")])

    return out.mapInArrow(run, schema)
