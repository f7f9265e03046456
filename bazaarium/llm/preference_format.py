"""Preference formatting of chosen and rejected conversations (operator 5).

The longest common prefix of turns, equal in role and text, is rendered once as the
prompt. What follows it on either side is a completion, with the spans that training
may learn from: the text and closing mark of assistant turns. Everything else, prompts
and later turns of other roles included, is masked. All of it is column expressions over
one shuffle by pair.

Turns are in the order of (turn, role, text), nulls first. A null role counts as an
empty one, a null text as an empty one. A repeated turn is a turn like any other. Turns
without a pair are left out; a pair without one of its sides has no common prefix, and
that side's id and completion are null. Spans are in code points of the completion, end
exclusive. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarium.llm.common import column

OPEN, SEPARATE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNT_ROLE = "assistant"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(SEPARATE), turn["text"], F.lit(CLOSE))


def _spans(turns: Column) -> Column:
    """start:end of what may be learnt, comma-joined."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(so_far: Column, turn: Column) -> Column:
        head = so_far["at"] + len(OPEN) + F.char_length(turn["role"]) + len(SEPARATE)
        end = head + F.char_length(turn["text"]) + len(CLOSE)
        span = F.array(F.concat_ws(":", head.cast("string"), end.cast("string")))
        learnt = F.when(turn["role"] == LEARNT_ROLE, F.concat(so_far["spans"], span)).otherwise(so_far["spans"])
        return F.struct(end.alias("at"), learnt.alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda done: done["spans"]), ",")


def format_pairs(turns: DataFrame, pair: Column, is_chosen: Column, conversation: Column) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans).

    turns has columns turn, role and text. pair tells which two conversations belong
    together, is_chosen which side a turn is on, conversation which id that side gets.
    """
    rows = turns.select(
        pair.alias("pair_id"),
        is_chosen.alias("is_chosen"),
        conversation.alias("id"),
        F.struct(
            column("turn").cast("long").alias("turn"),
            F.coalesce(column("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(column("text").cast("string"), F.lit("")).alias("text"),
        ).alias("said"),
    ).filter("pair_id is not null and is_chosen is not null")
    sides = rows.groupBy("pair_id").agg(
        F.min(F.when(F.col("is_chosen"), F.col("id"))).alias("chosen_id"),
        F.min(F.when(~F.col("is_chosen"), F.col("id"))).alias("rejected_id"),
        F.sort_array(F.collect_list(F.when(F.col("is_chosen"), F.col("said")))).alias("a"),
        F.sort_array(F.collect_list(F.when(~F.col("is_chosen"), F.col("said")))).alias("b"),
    )
    equal = F.zip_with("a", "b", lambda x, y: (x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])))
    differs = F.array_position(equal, False)
    common = F.when(differs == 0, F.size("a")).otherwise(differs - 1).cast("int")
    split = sides.withColumn("n_common", common)

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))

    split = split.withColumns({"shared": F.slice("a", F.lit(1), F.col("n_common")), "rest_a": rest("a"), "rest_b": rest("b")})

    def completion(side: str, turns: str) -> Column:
        return F.when(F.size(side) > 0, F.array_join(F.transform(turns, _rendered), ""))

    return split.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_common",
        F.array_join(F.transform("shared", _rendered), "").alias("prompt"),
        completion("a", "rest_a").alias("chosen"),
        completion("b", "rest_b").alias("rejected"),
        F.when(F.size("a") > 0, _spans(F.col("rest_a"))).alias("chosen_spans"),
        F.when(F.size("b") > 0, _spans(F.col("rest_b"))).alias("rejected_spans"),
    )
