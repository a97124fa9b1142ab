"""Preference formatting of conversation pairs, in DataFrame functions.

The longest common turn prefix of a chosen and a rejected conversation is rendered once, as the prompt;
what follows in each is its completion. Only what an assistant says in a completion is trained on: each
completion comes with the spans (code points, end excluded) that are not masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, sized

TURNS = "array<struct<role:string,text:string>>"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def turns_of(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: ``conv_id`` and ``turns`` (role, text) in order of turn, role and text.

    Null roles and texts are empty; null turns come first; each row without conversation is one of its
    own, so that they never meet in one task. Repeated rows are repeated turns. An empty table gives an
    empty one; other columns are not looked at.
    """
    row = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = df.select(F.col(f"`{conv_id}`").alias("conv_id"), row.alias("row"))
    found = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    found = found.unionByName(rows.where("conv_id is null").select("conv_id", F.array("row").alias("turns")))
    return found.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _body(text: Column) -> Column:
    """A text in which no marker of the template stands."""
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<$1>")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _body(turn["role"]), F.lit("\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t["text"]), F.lit(CLOSE))), "")


def _trained(turns: Column) -> Column:
    """Spans of the rendered turns in which an assistant speaks, its closing marker included."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(held: Column, t: Column) -> Column:
        begin = held["at"] + F.length(_head(t))
        end = begin + F.length(_body(t["text"])) + F.lit(len(CLOSE))
        span = F.array(F.struct(begin.alias("start"), (end - 1).alias("stop")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(held["spans"], span)).otherwise(held["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda held: held["spans"])


def format_preferences(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``pairs`` with ``n_prompt_turns``, ``prompt``, and for ``chosen`` and
    ``rejected`` (arrays of role and text): ``_completion`` and ``_trained`` (spans in the completion).

    Turns are common if role and text agree. Markers of the template that stand in roles or texts lose
    their bars (``<|im_end|>`` becomes ``<im_end>``), so that no text can open or close a turn. Equal
    conversations leave empty completions; a null one counts as one without turns. Row by row, without a
    shuffle: repeated rows stay, an empty table gives an empty one. A column in ``keep`` that is named like
    one made here is refused.
    """
    if clash := sorted({*keep} & {"n_prompt_turns", "prompt", *(f"{c}_{x}" for c in ("chosen", "rejected") for x in ("completion", "trained"))}):
        raise ValueError(f"columns named like those made here: {', '.join(clash)}")
    empty = F.array().cast(TURNS)
    at = pairs.select(*keep, F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"))
    same = F.zip_with("chosen", "rejected", lambda a, b: a.isNotNull() & b.isNotNull() & a.eqNullSafe(b))
    first = F.array_position(same, False)
    at = at.withColumn("n_prompt_turns", F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int"))
    rest = {c: F.slice(c, F.col("n_prompt_turns") + 1, F.size(c)) for c in ("chosen", "rejected")}
    prompt = _render(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt")
    made = [x for c, r in rest.items() for x in (_render(r).alias(f"{c}_completion"), _trained(r).alias(f"{c}_trained"))]
    return at.select(*keep, "n_prompt_turns", prompt, *made)


def _ordered(ids: DataFrame) -> DataFrame:
    """``ids`` with ``rank``: the place of each row in the order of ``conv_id`` (all different), from 0, and ``all`` rows.

    Sorted parts are written, so that their numbers hold; what comes before a part is summed over the parts.
    """
    parts = ids.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    held = materialise(parts.select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("k")), "ordered")
    sizes = held.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    offsets = materialise(sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("all")), "offsets")
    return held.join(sized(offsets), "part").withColumn("rank", F.col("before") + F.col("k")).drop("part", "k", "before")


def swapped_pairs(turns: DataFrame, block: int = 64) -> DataFrame:
    """Pairs from conversations alone: ``conv_id``, ``rejected_from``, ``chosen``, ``rejected``.

    A conversation is chosen over itself with its last assistant turn, and whatever follows it, replaced
    by the last assistant turn of another. Conversations with such a turn are taken ``block`` at a time in
    order of their ids, whatever their values (the last block takes what is left over, too), and each gets
    that of the next one in its block, the last one that of the first. One without such a turn, without id,
    or the only one of all is paired with itself.
    """
    single = turns.where("conv_id is null").select("conv_id", F.col("conv_id").alias("rejected_from"), F.col("turns").alias("chosen"), F.col("turns").alias("rejected"))
    last = F.coalesce(F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0))), F.lit(0))
    at = turns.where("conv_id is not null").withColumn("last", last)
    answers = _ordered(at.where("last > 0").select("conv_id", F.element_at("turns", F.greatest("last", F.lit(1))).alias("turn")))
    blocks = answers.withColumn("block", F.least(F.expr(f"rank div {block}"), F.greatest(F.expr(f"`all` div {block}") - 1, F.lit(0))))
    w = Window.partitionBy("block").orderBy("conv_id")
    other = F.struct("conv_id", "turn")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    given = blocks.select("conv_id", F.coalesce(F.lead(other).over(w), F.first(other).over(whole)).alias("other"))
    at = at.join(given, "conv_id", "left")
    swapped = F.concat(F.slice("turns", F.lit(1), F.greatest(F.col("last") - 1, F.lit(0))), F.array("other.turn"))
    swaps = at.select("conv_id", F.col("other.conv_id").alias("rejected_from"), F.col("turns").alias("chosen"), F.when(F.col("last") > 0, swapped).otherwise(F.col("turns")).alias("rejected"))
    return swaps.unionByName(single)
