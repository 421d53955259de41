"""Preference formatting: prompt once, then the masked completions of a chosen and a rejected conversation.

A conversation is an array of turns (role, text).  The longest common prefix of whole turns is the prompt; what follows
in each conversation is its completion.  A turn is rendered as ``<|im_start|>role``, a line feed, its text, ``<|im_end|>``
and a line feed; ``<|`` inside a text gets a blank, so that no text can end its turn.  The mask of a completion lists the
stretches to learn, ``begin-end`` in characters joined by commas: text and end mark of the assistant's turns.  All else
(headers, other roles) is masked, and the prompt is masked whole.

Built from DataFrame functions.  A conversation is one row, as its rendering is one value.  Defined results: null roles and
texts are empty, and a null conversation is one without turns; turns with equal numbers are ordered by role and text, and
repeated rows are turns each; rows without a conv_id are ignored; equal conversations have all turns in the prompt and empty
completions; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.operators.corpus import exact_rank

TURNS = "array<struct<role:string,text:string>>"
#: Turns whose stretches are joined before they are put to those before them.
BLOCK = 512


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), turn["role"], F.lit("\n"), turn["text"], F.lit("<|im_end|>\n"))


def _mask(turns: Column) -> Column:
    """Stretches of the assistant's turns in the rendering of ``turns``; lengths are summed up, nothing is rendered."""

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(t["role"]) + 13
        end = begin + F.length(t["text"]) + 10
        found = F.when(t["role"] == "assistant", F.concat(begin.cast("string"), F.lit("-"), end.cast("string")))
        return F.struct((end + 1).alias("at"), F.concat_ws(",", F.nullif(s["mask"], F.lit("")), found).alias("mask"))

    def block(s: Column, part: Column) -> Column:
        joined = lambda r: F.struct(r["at"].alias("at"), F.concat_ws(",", F.nullif(s["mask"], F.lit("")), F.nullif(r["mask"], F.lit(""))).alias("mask"))
        return F.aggregate(part, F.struct(s["at"].alias("at"), F.lit("").alias("mask")), step, joined)

    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("mask"))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(turns) / BLOCK).cast("int")), lambda k: F.slice(turns, k * BLOCK + 1, F.lit(BLOCK)))
    return F.aggregate(parts, none, block, lambda s: s["mask"])


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with the two arrays of turns replaced by prompt, prompt_turns, completions and masks."""
    rest = [c for c in pairs.columns if c not in (chosen, rejected)]
    safe = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(TURNS)), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    cut = pairs.select(*rest, safe(chosen).alias("a_"), safe(rejected).alias("b_"))
    a, b = F.col("a_"), F.col("b_")
    least = F.least(F.size(a), F.size(b))
    unlike = F.filter(F.when(least > 0, F.sequence(F.lit(0), least - 1)).otherwise(F.array().cast("array<int>")), lambda i: a[i] != b[i])
    cut = cut.select(*rest, "a_", "b_", F.coalesce(F.array_min(unlike), least).alias("n_"))
    after = lambda c: F.slice(F.col(c), F.col("n_") + 1, F.greatest(F.size(c) - F.col("n_"), F.lit(0)))
    cut = cut.select(*rest, "n_", F.slice("a_", F.lit(1), F.col("n_")).alias("p_"), after("a_").alias("a_"), after("b_").alias("b_"))
    text = lambda c: F.array_join(F.transform(c, _render), "")
    return cut.select(
        *rest,
        F.col("n_").cast("long").alias("prompt_turns"),
        text("p_").alias("prompt"),
        text("a_").alias("chosen"),
        text("b_").alias("rejected"),
        _mask(F.col("a_")).alias("chosen_mask"),
        _mask(F.col("b_")).alias("rejected_mask"),
    )


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, partner_id, status, chosen, rejected): a row for every conversation.

    Conversations with an assistant's turn are paired in order of their ids, the first with the second and so on.  A
    conversation up to its last assistant turn is chosen.  Rejected is the branch that leaves it after some of its turns (a
    number by hash of the id) and goes on as its partner does from there, or with the partner's last assistant turn
    where the partner is shorter.  ``status`` is paired, unpaired (the last of an odd number) or no_assistant; the
    latter two have null conversations.
    """
    safe = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("< |"))
    turn = F.struct("turn", safe("role").alias("role"), safe("text").alias("text"))
    every = conversations.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    every = every.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("t"))
    last = F.array_max(F.transform("t", lambda t, i: F.when(t["role"] == "assistant", i + 1)))
    every = every.withColumn("n", last)
    own = conversations.filter("conv_id is not null and role = 'assistant'").select("conv_id").distinct()
    ranks = exact_rank(own, ["conv_id"])
    found = every.filter("n is not null").join(ranks, "conv_id").select(
        F.floor(F.col("rank") / 2).alias("k"), F.struct("conv_id", "n", F.slice("t", F.lit(1), F.col("n")).alias("t")).alias("c")
    )
    both = found.groupBy("k").agg(F.array_sort(F.collect_list("c")).alias("c"))
    sides = both.select("c", F.posexplode("c").alias("i", "own"))
    sides = sides.select("own", F.get("c", 1 - F.col("i")).alias("other"))
    roll = F.conv(F.substring(F.md5(F.col("own.conv_id").cast("string")), 1, 8), 16, 10).cast("long")
    sides = sides.withColumn("cut", F.pmod(roll, F.col("own.n")).cast("int"))
    more = F.when(F.col("other.n") > F.col("cut"), F.slice("other.t", F.col("cut") + 1, F.col("other.n") - F.col("cut"))).otherwise(F.slice("other.t", F.col("other.n"), F.lit(1)))
    paired = sides.filter("other is not null").select(
        F.col("own.conv_id").alias("pair_id"), F.col("other.conv_id").alias("partner_id"), F.lit("paired").alias("status"), F.col("own.t").alias("chosen"), F.concat(F.slice("own.t", F.lit(1), F.col("cut")), more).alias("rejected")
    )
    none = [F.lit(None).cast("long").alias("partner_id"), *(F.lit(None).cast(TURNS).alias(c) for c in ("chosen", "rejected"))]
    alone = lambda rows, name, status: rows.select(F.col(name).alias("pair_id"), F.lit(status).alias("status"), *none)
    out = paired.unionByName(alone(sides.filter("other is null"), "own.conv_id", "unpaired"))
    return out.unionByName(alone(every.filter("n is null"), "conv_id", "no_assistant"))


def preferences(conversations: DataFrame) -> DataFrame:
    """``conversation_pairs`` formatted; those without a partner have nulls."""
    done = format_preferences(conversation_pairs(conversations))
    kept = ["pair_id", "partner_id", "status"]
    return done.select(*kept, *(F.when(F.col("status") == "paired", F.col(c)).alias(c) for c in done.columns if c not in kept))
