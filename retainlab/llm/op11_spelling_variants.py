"""Spelling variant grouping by asymmetric q-chunks.

1. ``word_counts``: the letter runs of all texts, counted per batch before they are shuffled.  A
   share of the runs, chosen by a hash of id and run, loses one character on the way: variants
   whose origin is known.
2. ``near_words``: of two words one edit apart, take the shorter (of equal lengths each in turn).
   It contributes two disjoint chunks, its halves; the other word contributes its positional grams,
   namely those that begin within one position of a chunk.  One edit spoils one chunk at most, and
   the other is a gram of the longer word, shifted by the difference in length if it stands behind
   the edit.  Words are joined on the chunk, its place and both lengths, and each pair is verified
   by its edit distance.
3. Chunks shared by many words (a common stem or ending) are not paired: where a group would give
   more than ``PAIRS`` pairs, the same rule is applied to the rest of its words, so that one half of
   the rest is added to the key, again and again.  At the end all but one character is in the key
   and a group is no larger than the alphabet, so every group is joined in bounded size and no pair
   is lost.
4. ``grouped``: a word's form is its near word of the largest count, if that is at least twice its
   own; roots follow the forms by pointer doubling (counts double at each step, so chains are short).

Edge cases: null and empty texts hold no words; a null id hashes as an empty one; repeated rows
count once each; ties go to the smallest word in code-point order; a run of any length is one word
(keys are hashes, pairs are verified on whole words); an empty table gives an empty result; columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainlab.llm.runtime import cut, lean
from retainlab.llm.textwords import LOWER, column

RUN = "[a-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT = 5, 3
#: one run in SPOIL loses a character
SPOIL = 97
#: pairs that a group is joined to without splitting it further
PAIRS = 1 << 14
#: characters up to which the edit distance, quadratic in them, verifies a pair
SHORT = 64
#: distinct words that a task counts before it hands them on
FLUSH = 1 << 17


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, spoil: int = SPOIL) -> DataFrame:
    """(word, n): the words of at least ``min_chars`` code points that occur ``min_count`` times or more."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, lower = re.compile(RUN), LOWER.tobytes()
        count: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())],
                                             names=["word", "n"])
            count.clear()
            return out

        for batch in batches:
            ids = column(batch, "doc_id").to_pylist()
            for doc_id, text in zip(ids, column(batch, "text").cast(pa.binary())):
                if not text.is_valid:
                    continue
                start = zlib.crc32(b"%s:" % str("" if doc_id is None else doc_id).encode())
                for word, n in Counter(runs.findall(text.as_py().translate(lower).decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % spoil == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= min_chars:
                        count[word] += n
                if len(count) >= FLUSH:
                    yield flush()
        yield flush()

    src = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return (src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def _split(a: Column, b: Column, more: Column) -> Column:
    """The halves of the stretch [a, b) that may still hold the edit; at one character, for an insertion, its two gaps."""
    m = F.floor((a + b) / 2).cast("int")

    def part(x: Column, y: Column) -> Column:
        return F.struct(x.alias("a"), y.alias("b"))

    return (F.when(b - a >= 2, F.array(part(a, m), part(m, b)))
            .when((b - a == 1) & (more == 1), F.array(part(a, a), part(b, b))))


def _narrowed(members: DataFrame) -> DataFrame:
    """Members with one half of their open stretch added to the key.

    ``size``: length of the shorter word; ``more``: 1 if the other is longer; ``longer``: whether this word is the
    other one.  All characters outside the open stretch are the key, with its place and the sizes.
    """
    opened = members.withColumn("_s", F.explode(_split(F.col("a"), F.col("b"), F.col("more")))).select(
        "word", "size", "more", "longer", F.col("_s.a").alias("a"), F.col("_s.b").alias("b"))
    after = F.col("b") + F.col("longer") + 1
    return opened.withColumn("key", F.xxhash64(
        "size", "more", "a", "b", F.substring("word", F.lit(1), F.col("a")),
        F.substring("word", after, F.greatest(F.col("size") + F.col("longer") - after + 1, F.lit(0)))))


def _one_edit(x: str, y: str) -> bool:
    """Whether ``y``, as long as ``x`` or one longer, is one edit away: linear, for long words."""
    lo, hi = 0, len(x)  # the common prefix
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[lo:mid] == y[lo:mid] else (lo, mid - 1)
    return x != y and x[lo + (len(x) == len(y)):] == y[lo + 1:]


def _one_edit_long(x: str, y: str) -> Column:
    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_one_edit(v, w) for v, w in zip(a, b)], dtype=bool)

    return near(x, y)


def near_words(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(x, y): all unordered pairs of distinct ``word`` that one inserted, deleted or replaced character turns into each other.

    Words have two characters at least.
    """
    size = F.char_length("word").cast("int")
    roles = F.array(*[F.struct((size - longer).alias("size"), F.lit(more).alias("more"), F.lit(longer).alias("longer"))
                      for more, longer in ((0, 0), (1, 0), (1, 1))])
    whole = words.select("word", F.explode(roles).alias("r")).select("word", "r.*").where("size > 0").select(
        "*", F.lit(0).alias("a"), F.col("size").alias("b"))
    members, found = cut(_narrowed(whole)), None
    while True:
        longer = F.sum("longer")
        other = F.when(F.max("more") == 1, longer).otherwise(F.count(F.lit(1)))
        groups = members.groupBy("key").agg((F.count(F.lit(1)) - longer).alias("_x"), other.alias("_y")).where(
            "_x > 0 AND _y > 0 AND _x + _y > 1").select("key", (F.col("_x") * F.col("_y")).alias("_pairs"))
        sized = cut(members.join(groups, "key"))
        # a group whose open stretch cannot be split any more is bounded by the alphabet
        open_ = (F.col("_pairs") > pairs) & _split(F.col("a"), F.col("b"), F.col("more")).isNotNull()
        small = sized.where(~open_)
        one = small.where("longer = 0").select("key", "more", "size", F.col("word").alias("x"))
        two = small.where("longer = more").select("key", F.col("word").alias("y"))
        for short, near in ((True, F.levenshtein("x", "y", 1) == 1), (False, _one_edit_long("x", "y"))):
            own = one.where(F.col("size") <= SHORT if short else F.col("size") > SHORT)
            part = own.join(two, "key").where((F.col("more") == 1) | (F.col("x") < F.col("y"))).where(near).select("x", "y")
            found = part if found is None else found.unionByName(part)
        members = cut(_narrowed(sized.where(open_)))
        if members.isEmpty():
            return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that each word of ``forms`` (word, form) leads to."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = cut(now.join(ahead, F.col("root") == F.col("_w"), "left").select(
            "word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")))
        now = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return now


def grouped(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, spoil: int = SPOIL) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root (see the module text)."""
    words = cut(word_counts(docs, min_chars, min_count, spoil))
    near = cut(near_words(words.select("word")))
    both = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y")))
    best = (both.join(words.select(F.col("word").alias("y"), F.col("n").alias("_n")), "y").groupBy("x")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("n"), F.col("y").alias("word"))).alias("_b")))
    named = words.join(best, F.col("word") == F.col("x"), "left")
    is_form = -F.col("_b.n") >= 2 * F.col("n")
    named = cut(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                             F.when(is_form, F.col("_b.word")).alias("form"), F.when(is_form, -F.col("_b.n")).alias("form_n")))
    last = roots(named.where("form IS NOT NULL"))
    return named.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
