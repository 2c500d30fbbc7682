"""Multi-party chat formatting: the dialogue from every participant's side (DataFrame functions only).

For each participant the whole dialogue is rendered with that speaker as
``assistant``, everybody else as ``user`` with their name, and the
participant's own words marked for training. Narrators (``system`` by
default) keep their role and are no participants.

A dialogue is rendered in parts of ``part_turns`` turns, so no row holds an
unbounded text. The messages of a part are numbered in order of turn, role
and text and cut into pieces of ``most`` messages, whatever the size: a part
of up to ``most`` messages has one piece. The pieces of a dialogue in order
(``part``, ``piece``) are the whole dialogue. Numbers come from a global range
sort, not from a window over a part, so a part with very many messages is no
task's alone. The result has every message once for each participant of its
dialogue: that product is what is asked for.

Nulls and odd rows: equal rows are one message; several messages of a turn
are ordered by role and text (nulls first); a message without a turn has no
place, so it is rendered alone (null part, a piece each, numbered by role and
text); a null role is an unnamed user and no participant; a null text is
empty; a long text is never cut; rows without a conversation id form one
conversation; a conversation without participants has no rows; other columns
are not looked at, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custos.llm.common import stored
from custos.operators.ordering import with_position

NARRATORS = ("system",)
PART_TURNS = 64
MOST = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def inert(text: Column) -> Column:
    """Text in which a control mark of the format cannot occur."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def _numbered(said: DataFrame) -> DataFrame:
    """``said`` with ``at``: the place of each message in its conversation and part, from 0."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "part", "turn", "role", "text")]
    ranked = stored(with_position(said, order, "pos"), "ranked-messages")
    first = stored(ranked.groupBy("conv_id", "part").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
                   .select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "_first", "_n"), "parts")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("part").eqNullSafe(F.col("_p"))
    # parts with more than a thousandth of all messages: a thousand at most, sent to all tasks
    crowded = F.col("_n") * 1000 > ranked.count()
    most, rest = F.broadcast(first.filter(crowded)), first.filter(~crowded)
    met = ranked.join(most, same).unionByName(ranked.join(most, same, "left_anti").join(rest, same))
    return met.withColumn("at", F.col("pos") - F.col("_first")).drop("pos", "_first", "_n", "_c", "_p")


def perspectives(messages: DataFrame, conv_id: Column, turn: Column, role: Column, text: Column,
                 narrators: Sequence[str] = NARRATORS, part_turns: int = PART_TURNS, most: int = MOST) -> DataFrame:
    """``(conv_id, perspective, part, piece, n_messages, n_own, text, spans)``.

    ``spans`` are the ``(start, end)`` places, in characters of ``text``, of
    the participant's words with their closing mark: what is trained on.
    """
    said = messages.select(conv_id.alias("conv_id"), turn.cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    said = stored(said.distinct().withColumn("part", F.floor(F.col("turn") / part_turns)), "messages")
    narrator = F.col("role").isin(list(narrators))
    speakers = said.filter(F.col("role").isNotNull() & ~narrator).select(
        F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    piece = F.when(F.col("part").isNull(), F.col("at")).otherwise(F.expr(f"at div {int(most)}"))
    said = _numbered(said).select("conv_id", "part", piece.alias("piece"), F.struct("turn", "role", "text").alias("message"))
    parts = said.groupBy("conv_id", "part", "piece").agg(F.array_sort(F.collect_list("message")).alias("said"))
    sides = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))

    def rendered(m: Column) -> Column:
        own = F.coalesce(m["role"] == F.col("perspective"), F.lit(False))
        name = F.when(m["role"].isNotNull(), F.concat(F.lit(" name="), inert(m["role"]))).otherwise("")
        head = F.when(own, F.lit("assistant")).when(m["role"].isin(list(narrators)), m["role"]).otherwise(
            F.concat(F.lit("user"), name))
        return F.struct(F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"),
                        F.concat(inert(m["text"]), F.lit(CLOSE)).alias("body"), own.alias("own"))

    sides = sides.withColumn("lines", F.transform("said", rendered))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def add(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.length(m["head"])
        end = begin + F.length(m["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(m["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("lines", start, add, lambda acc: acc["spans"])
    whole = F.array_join(F.transform("lines", lambda m: F.concat(m["head"], m["body"], F.lit("\n"))), "")
    return sides.withColumn("spans", spans).select(
        "conv_id", "perspective", "part", "piece", F.size("lines").alias("n_messages"),
        F.size("spans").alias("n_own"), whole.alias("text"), "spans")
