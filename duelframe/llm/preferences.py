"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation, rendered once as prompt,
and both completions with masks.

Only DataFrame functions and one shuffle: the turns of a pair become one row, as the result has them. A pair's turns are
so one value in a task (a conversation must fit there, as it must in the row that holds its text); pairs are spread by
their id, however many there are.

Turns are ordered by number, then role and text. A turn is common if role and text are equal, null being equal to null.
Masks list the spans of a completion that a loss counts, the texts of the assistant's turns, as [start, end) in
characters. Rendering is ChatML; special strings inside texts stay as they are.

Defined results: a null text counts as empty and a null role is rendered as `unknown`; rows with a null pair are of no
pair and go; a missing side gives null completions of that side, an empty prompt and `tied` false; identical sides give
two empty completions and `tied` true; repeated turns are repeated; an empty table gives an empty result; other columns
are not read.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.session import tune

ASSISTANT = "assistant"


def _head(turn):
    return F.concat(F.lit("<|im_start|>"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("\n"))


def _body(turn):
    return F.coalesce(turn["text"], F.lit(""))


_TAIL = "<|im_end|>\n"


def _render(turns):
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit(_TAIL))), "")


def _mask(turns):
    """Spans of the assistant's texts in the rendered turns."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc, t):
        start = acc["at"] + F.length(_head(t))
        end = start + F.length(_body(t))
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == ASSISTANT, F.concat(acc["spans"], own)).otherwise(acc["spans"])
        return F.struct((end + F.lit(len(_TAIL))).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, empty, add, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame, pair_col="pair_id", chosen_col="is_chosen", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """pair, n_prompt_turns, tied, prompt, chosen, rejected, chosen_mask, rejected_mask from a row for each turn."""
    tune(turns.sparkSession)
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = turns.filter(F.col(pair_col).isNotNull() & F.col(chosen_col).isNotNull()).select(F.col(pair_col).alias("pair"), F.col(chosen_col).alias("side"), turn.alias("t"))
    sides = rows.groupBy("pair").agg(
        F.sort_array(F.collect_list(F.when(F.col("side"), F.col("t")))).alias("c"),
        F.sort_array(F.collect_list(F.when(~F.col("side"), F.col("t")))).alias("r"))
    both = (F.size("c") > 0) & (F.size("r") > 0)
    same = F.zip_with("c", "r", lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first_other = F.array_position(same, F.lit(False))
    common = F.when(~both, 0).when(first_other == 0, F.size("c")).otherwise(first_other - 1).cast("int")
    sides = sides.withColumn("n", common)

    def rest(side):
        return F.slice(side, F.col("n") + 1, F.size(side))

    def of(side, what):
        return F.when(F.size(side) > 0, what(rest(side)))

    return sides.select(
        F.col("pair").alias(pair_col), F.col("n").alias("n_prompt_turns"), (both & (F.col("n") == F.size("c")) & (F.col("n") == F.size("r"))).alias("tied"),
        _render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"), of("c", _render).alias("chosen"), of("r", _render).alias("rejected"),
        of("c", _mask).alias("chosen_mask"), of("r", _mask).alias("rejected_mask"))


def pairs_from_conversations(conversations: DataFrame) -> DataFrame:
    """Pairs for a table of plain conversations: each is the chosen side, and with its last reply replaced by the last reply
    of the conversation with the next id it is the rejected side. One without a reply, or without a next, has no rejected side."""
    base = conversations.select("conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull())
    replies = base.filter(F.col("role") == ASSISTANT).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = replies.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("other_text"))
    swap = replies.join(other, "conv_id").select("conv_id", F.col("last.turn").alias("last_turn"), "other_text")
    rejected = base.join(swap, "conv_id")
    last = (F.col("turn") == F.col("last_turn")) & (F.col("role") == ASSISTANT)
    rejected = rejected.withColumn("text", F.when(last, F.col("other_text")).otherwise(F.col("text"))).select("conv_id", "turn", "role", "text")
    return base.withColumn("is_chosen", F.lit(True)).unionByName(rejected.withColumn("is_chosen", F.lit(False))).withColumnRenamed("conv_id", "pair_id")
