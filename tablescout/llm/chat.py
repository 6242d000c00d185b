"""Preference formatting of chosen and rejected conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TURN = "struct<role:string,text:string>"


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and its ``turns`` as a list of (role, text), from rows ``(conv_id, turn, role, text)``.

    Turns are in the order of ``turn``, ties by role and text, and rows repeated as a whole count once; null turns come first, null
    roles and texts count as empty. Rows with a null ``conv_id`` belong to no conversation and are left out.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set(row)).alias("all"))
    return listed.select("conv_id", F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_prefix(chosen, rejected):
    """Number of leading turns that are equal in both."""
    same = F.zip_with(chosen, rejected, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _rendered(turns):
    """Turns in one text, each as its role, its words and an end mark."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _mask(turns):
    """Character spans ``start, end`` of a rendered text that are learned: the words and end mark of assistant turns."""
    def step(done, t):
        head = done["at"] + 5 + F.length(t["role"])
        end = head + F.length(t["text"]) + 7
        span = F.when(t["role"] == "assistant", F.array(F.struct(head.alias("start"), end.alias("end"))))
        return F.struct((end + 1).alias("at"), F.concat(done["spans"], F.coalesce(span, F.expr("cast(array() AS array<struct<start:int,end:int>>)"))).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<struct<start:int,end:int>>)").alias("spans"))
    return F.aggregate(turns, start, step, lambda done: done["spans"])


def formatted(pairs: DataFrame) -> DataFrame:
    """Prompt and masked completions for each row of ``pairs``, which holds ``chosen`` and ``rejected`` as lists of (role, text).

    The longest prefix of equal turns is rendered once as ``prompt``; what follows in either conversation is its completion, with
    ``_mask`` the spans of it that are learned. Equal conversations have empty completions; null lists count as empty. Other columns stay.
    """
    turn = F.expr(f"cast(array() AS array<{_TURN}>)")
    pairs = pairs.withColumn("chosen", F.coalesce("chosen", turn)).withColumn("rejected", F.coalesce("rejected", turn))
    pairs = pairs.withColumn("prefix_turns", common_prefix(F.col("chosen"), F.col("rejected")))

    def rest(column):
        return F.slice(F.col(column), F.col("prefix_turns") + 1, F.greatest(F.size(column), F.lit(1)))

    return pairs.select(
        *(c for c in pairs.columns if c not in ("chosen", "rejected")), _rendered(F.slice("chosen", F.lit(1), F.col("prefix_turns"))).alias("prompt"),
        _rendered(rest("chosen")).alias("chosen_completion"), _mask(rest("chosen")).alias("chosen_mask"),
        _rendered(rest("rejected")).alias("rejected_completion"), _mask(rest("rejected")).alias("rejected_mask"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """A pair for each conversation: ``chosen_id, rejected_id, chosen, rejected``.

    Conversations that begin with the same turn answer the same prompt: the one with the smallest id is chosen over every other. A conversation
    with the smallest id is chosen over itself with its last assistant turn replaced by its first, which answers something else
    (dropped where they are one and the same); ``rejected_id`` is null then.
    """
    talks = conversations(turns).withColumn("opening", F.xxhash64(F.col("turns")[0]))
    first = talks.groupBy("opening").agg(F.min_by("turns", "conv_id").alias("chosen"), F.min("conv_id").alias("chosen_id"))
    others = talks.join(first, "opening").where("conv_id <> chosen_id")
    others = others.select("chosen_id", F.col("conv_id").alias("rejected_id"), "chosen", F.col("turns").alias("rejected"))
    said = F.filter("chosen", lambda t: t["role"] == "assistant")
    roles = F.transform("chosen", lambda t: t["role"])
    last = F.size("chosen") - F.array_position(F.reverse(roles), "assistant").cast("int")
    stale = F.when(F.size(said) == 0, F.col("chosen")).otherwise(F.concat(
        F.slice("chosen", F.lit(1), last), F.when(F.size(said) > 1, F.slice(said, 1, 1)).otherwise(F.slice(said, 1, 0)),
        F.slice("chosen", last + 2, F.size("chosen"))))
    own = first.select("chosen_id", F.lit(None).cast(others.schema["rejected_id"].dataType).alias("rejected_id"), "chosen", stale.alias("rejected"))
    return others.union(own)
