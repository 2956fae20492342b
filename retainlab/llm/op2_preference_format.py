"""Preference formatting: one prompt, two masked completions.

For each pair the longest common turn prefix of the chosen and the rejected conversation
(equal role and text, turn by turn) is rendered once as the prompt; the turns after it
are the completions.  A mask lists the character spans of ``prompt + completion`` that
count for the loss: content and end mark of the completion's assistant turns.

Everything is a DataFrame expression; the only shuffle brings the turns of a pair
together, which are one output row.

Edge cases: a null role or text is empty; turns are ordered by (turn, role, text), with
null turns first, and repeated rows stay repeated turns; a null id is an id of its own;
conversations of one side only pair with an empty one; status is ``identical`` if both are
the same (no completion), ``prefix`` if one is a prefix of the other, else ``pair``; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns): the ordered turns of each conversation as an array of (role, text)."""
    t = F.struct(F.col("`turn`").alias("turn"), F.coalesce(F.col("`role`").cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col("`text`").cast("string"), F.lit("")).alias("text"))
    return conversations.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.sort_array(F.collect_list(t)).alias("_t")).select(
        "id", F.transform("_t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _render(t: Column) -> Column:
    """<|role|>, a line feed, the text, the end mark and a line feed, for each turn."""
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))


def _joined(rendered: Column) -> Column:
    return F.array_join(rendered, "")


def _mask(tail: Column, rendered: Column, start: Column) -> Column:
    """Spans (start, end) of the trained content in prompt + completion."""
    begin = F.struct(start.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, i: Column) -> Column:
        t, size = F.element_at(tail, i), F.length(F.element_at(rendered, i))
        span = F.struct((acc["at"] + F.length(t["role"]) + 5).cast("long").alias("start"), (acc["at"] + size - 1).cast("long").alias("end"))
        return F.struct((acc["at"] + size).cast("long").alias("at"),
                        F.when(t["role"] == TRAINED_ROLE, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    numbers = F.when(F.size(tail) > 0, F.sequence(F.lit(1), F.size(tail))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, begin, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs``: (id, chosen, rejected), arrays of (role, text).

    Returns id, status, n_prompt_turns, prompt, chosen, rejected (completions), chosen_mask, rejected_mask.
    """
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(a.eqNullSafe(b), F.lit(False)))
    first = F.array_position(same, False)
    n = F.when(first > 0, first - 1).otherwise(F.least(F.size("chosen"), F.size("rejected"))).cast("int")
    cut = pairs.withColumn("n_prompt_turns", n)
    a, b, k = F.size("chosen"), F.size("rejected"), F.col("n_prompt_turns")
    cut = cut.select(
        "id", "n_prompt_turns",
        F.when((k == a) & (k == b), "identical").when((k == a) | (k == b), "prefix").otherwise("pair").alias("status"),
        F.slice("chosen", F.lit(1), k).alias("_p"), F.slice("chosen", k + 1, a).alias("_c"), F.slice("rejected", k + 1, b).alias("_r"))
    for c in "pcr":
        cut = cut.withColumn(f"_{c}s", F.transform(f"_{c}", _render))
    cut = cut.withColumn("prompt", _joined(F.col("_ps")))
    at = F.length("prompt")
    return cut.select("id", "status", "n_prompt_turns", "prompt", _joined(F.col("_cs")).alias("chosen"),
                      _joined(F.col("_rs")).alias("rejected"), _mask(F.col("_c"), F.col("_cs"), at).alias("chosen_mask"),
                      _mask(F.col("_r"), F.col("_rs"), at).alias("rejected_mask"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Pair two long tables (id, turn, role, text) by id and format them."""
    one, two = turns(chosen, id_col).withColumnRenamed("turns", "chosen"), turns(rejected, id_col).withColumnRenamed("turns", "rejected")
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = one.alias("c").join(two.alias("r"), F.col("c.id").eqNullSafe(F.col("r.id")), "full")
    return format_pairs(both.select(F.coalesce("c.id", "r.id").alias("id"), F.coalesce("chosen", none).alias("chosen"),
                                    F.coalesce("rejected", none).alias("rejected")))


def stale_reply_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs made of one conversation: chosen up to its last reply, rejected with the first reply in that place.

    With one reply only, the rejected conversation ends before it; without a reply both are the conversation.
    """
    t = turns(conversations)
    numbers = F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == TRAINED_ROLE, i + 1)), lambda i: i.isNotNull())
    t = t.withColumn("_a", numbers)
    last, first = F.element_at("_a", -1), F.element_at("_a", 1)
    before = F.slice("turns", F.lit(1), F.greatest(last - 1, F.lit(0)))
    return t.select(
        "id", F.when(F.size("_a") == 0, F.col("turns")).otherwise(F.slice("turns", F.lit(1), last)).alias("chosen"),
        F.when(F.size("_a") == 0, F.col("turns")).when(F.size("_a") == 1, before)
        .otherwise(F.concat(before, F.slice("turns", first, F.lit(1)))).alias("rejected"))


def digest(formatted: DataFrame) -> DataFrame:
    def spans(c: str) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")

    def sha(c: str) -> Column:
        return F.sha2(F.col(c).cast("binary"), 256)

    return formatted.select(
        F.col("id").alias("conv_id"), "status", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        F.length("prompt").cast("long").alias("prompt_chars"), sha("prompt").alias("prompt_sha256"),
        sha("chosen").alias("chosen_sha256"), sha("rejected").alias("rejected_sha256"),
        spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"))
