"""Fill-in-middle transformation by repeated-capture matching.

A text is a run of units (a word of ASCII letters, or one other character).  One full match of
``(unit)*`` with the regex library keeps the end of every repetition; the list of ends gives the
number of units and both cut offsets by index, without walking the units.  Where a text is cut and
in which form it is written depends on a hash of its id alone, so a rerun gives the same output.

Texts longer than ``PIECE`` code points are matched piece by piece, each ending behind a character
that is no letter (so no unit is split), because one match keeps all its captures in memory.

Edge cases: a null text counts as empty; empty texts, and texts that hold one of the three marks,
stay plain; a null id hashes as an empty one; repeated rows are transformed alike, each on its own;
a text of one very long word is one unit; empty tables give empty results; columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainlab.llm.runtime import lean
from retainlab.llm.textwords import column

UNITS = r"([A-Za-z]+|[^A-Za-z])*"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: code points of one match
PIECE = 1 << 18


def unit_ends(text: str, piece: int = PIECE) -> np.ndarray:
    """The end of every unit of ``text``."""
    import regex

    units, other = regex.compile(UNITS), regex.compile("[^A-Za-z]")
    ends, at = [np.zeros(0, np.int64)], 0
    while at < len(text):
        stop = len(text)
        if at + piece < stop:
            gap = other.search(text, at + piece - 1)
            stop = gap.end() if gap else stop
        ends.append(np.array(units.fullmatch(text, at, stop).ends(1), np.int64))
        at = stop
    return np.concatenate(ends)


def _draw(word: int, seed: int) -> Column:
    """The ``word``-th 8-digit group of the hash of ``seed`` and the id, as an unsigned integer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("long")


def cuts(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Per document: doc_id, text, n (units), and the code point offsets ``a`` and ``b`` of both cuts."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (column(batch, c).to_numpy() for c in ("_h1", "_h2"))
            n, a, b = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for k, text in enumerate(column(batch, "text")):
                ends = unit_ends(text.as_py())
                n[k] = len(ends)
                x, y = sorted((first[k] % (n[k] + 1), second[k] % (n[k] + 1)))
                a[k], b[k] = ends[x - 1] if x else 0, ends[y - 1] if y else 0
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "text"), pa.array(n), pa.array(a), pa.array(b)],
                names=["doc_id", "text", "n", "a", "b"])

    src = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.coalesce(F.col("`text`"), F.lit("")).alias("text"))
    return src.select("doc_id", "text", _draw(0, seed).alias("_h1"), _draw(1, seed).alias("_h2")).mapInArrow(
        run, "doc_id long, text string, n long, a long, b long")


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """Per document: doc_id, text, n, form (plain, psm, spm), output, prefix_chars, middle_chars (null if plain).

    ``plain`` is the percentage of documents that stay as they are, ``spm`` the percentage of the others that
    are written with the suffix first.
    """
    text, a, b = F.col("text"), F.col("a").cast("int"), F.col("b").cast("int")
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = (F.when((text == "") | marked | (_draw(2, seed) % 100 >= 100 - plain), "plain")
            .when(_draw(3, seed) % 100 < spm, "spm").otherwise("psm"))
    first, middle = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a)
    last = F.substring(text, b + 1, F.char_length(text))
    cut = F.col("form") != "plain"
    return cuts(docs, seed).withColumn("form", form).select(
        "doc_id", "text", "n", "form",
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), first, F.lit(SUFFIX), last, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), last, F.lit(PREFIX), first, F.lit(MIDDLE), middle))
        .otherwise(text).alias("output"),
        F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"))


def restore(output: str = "output", form: str = "form") -> Column:
    """The text that ``output`` was made from.  A written text holds each mark once, so the marks cut it exactly."""
    o = F.col(output)

    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(o, end, 1), start, -1)

    middle = F.substring_index(o, MIDDLE, -1)
    return (F.when(F.col(form) == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .when(F.col(form) == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))).otherwise(o))


def digest(done: DataFrame) -> DataFrame:
    """Hashes of ``fill_in_middle``'s output and of the text restored from it, with the counts."""
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore().cast("binary"), 256).alias("restored_sha256"))
