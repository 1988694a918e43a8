"""Preference pairs: one shared prompt, and two completions with training masks.

Chosen and rejected conversations are compared turn by turn. Their longest common
prefix of turns is rendered once as the prompt; what follows on each side is its
completion. In a completion only what the assistant says is trained on; spans of
characters say where that is: a token is trained on when its offsets, as a tokenizer
gives them for the completion, lie inside of a span. Marks that stand in what is said
are spaced out, so that no text can open or close a turn. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"


def header(role: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"))


FOOTER = "<|im_end|>\n"


def plain(said: Column) -> Column:
    """A text or role in which no mark of a turn stands."""
    return F.regexp_replace(said.cast("string"), r"<\|(im_start|im_end)\|>", "<| $1 |>")


def _side(turns: DataFrame, conv: str, turn: str, name: str) -> DataFrame:
    said = F.struct(plain(F.col("role")).alias("role"), plain(F.col("text")).alias("text"))
    place = F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 63)))
    return turns.select(F.col(conv).alias("conv"), place.alias("place"), F.lit(name).alias("side"), said.alias("said"))


def _rendered(turns: Column) -> Column:
    """All turns in order as one text."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(header(t["said"]["role"]), F.coalesce(t["said"]["text"], F.lit("")), F.lit(FOOTER))))


def _spans(turns: Column) -> Column:
    """``start`` and ``end`` (characters of the rendered text) of what the assistant says, its end mark included."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        head = F.length(header(t["said"]["role"])).cast("long")
        start = state["at"] + head
        end = start + F.length(F.coalesce(t["said"]["text"], F.lit(""))) + F.lit(len(FOOTER))
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["said"]["role"] == ASSISTANT, F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def pair(chosen: DataFrame, rejected: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row for each conversation of either side: ``conv``, ``n_prompt`` (turns of the common prefix), ``prompt``,
    ``chosen`` and ``rejected`` (rendered completions), ``chosen_spans`` and ``rejected_spans``.

    Both inputs have ``conv``, ``turn``, ``role`` and ``text``; other columns are left out. Turns stand in the order of
    their numbers, a null one first, and those that share a number in the order of role and text; rows that repeat one
    on a side count once. A null text is an empty one, a null role an empty role. Null conversation ids are one
    conversation. Equal sides have empty completions, a side without turns an empty one, and empty inputs give no rows.
    """
    both = _side(chosen, conv, turn, "c").unionByName(_side(rejected, conv, turn, "r"))
    of = lambda s: F.max(F.col("side") == s)
    turns = both.groupBy("conv", "place", "said").agg(of("c").alias("c"), of("r").alias("r"))
    at = F.struct("place", "said")
    listed = turns.groupBy("conv").agg(
        F.min(F.when(~(F.col("c") & F.col("r")), at)).alias("split"),
        F.array_sort(F.collect_list(F.struct("place", "said", "c", "r"))).alias("turns"),
    )

    def part(side: str, common: bool) -> Column:
        # turns are sorted alike on both sides: the first that one of them lacks ends the prefix
        before = lambda t: F.col("split").isNull() | (F.struct(t["place"].alias("place"), t["said"].alias("said")) < F.col("split"))
        inside = lambda t: before(t) if common else ~before(t) & t[side]
        return F.transform(F.filter("turns", inside), lambda t: F.struct(t["said"].alias("said")))

    parts = listed.select("conv", part("c", True).alias("p"), part("c", False).alias("c"), part("r", False).alias("r"))
    return parts.select(
        F.col("conv").alias(conv), F.size("p").cast("long").alias("n_prompt"), _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"), _spans(F.col("c")).alias("chosen_spans"), _spans(F.col("r")).alias("rejected_spans"),
    )
