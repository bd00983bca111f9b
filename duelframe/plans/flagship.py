"""Flagship query: contests -> two rows each -> careers of both sides -> prices -> Kelly stakes per day."""

from pyspark.sql import functions as F

from ..operators.bets import period_stakes, with_kelly
from ..operators.careers import career_table
from ..operators.joins import attach_both_sides
from ..session import bucketed
from .standin import K, day, priced, rd

FEATURES = ["n_career", "n_flagged", "days_since_first", "days_since_prev", "total_duration", "min_cls", "max_cls", "prev_cls"]


def career_edges(spark, sf_dir):
    base = priced(spark, sf_dir).withColumns({
        "is_flagged": F.col("flag") == "R", "weight": F.substring("cls", 1, 1).cast("int"), "seconds": F.col("side_q")})
    # Both tables lie in buckets of the contest, so neither stakes nor careers of both sides move a row when joined.
    base = bucketed(base, "contest", "contests")
    careers = bucketed(career_table(base, K, flag="is_flagged", duration="seconds", cls="weight"), "contest", "careers")
    # Stakes first: their per-day totals then read the contests alone, not the joined careers.
    staked = period_stakes(with_kelly(base), "d", cap=0.25, written=True)
    both = attach_both_sides(staked, careers, "contest", K, bucket="contest")
    return both.select(
        "contest", day("d").alias("d"), "side", "opp", "n_career", "n_career_opp", "n_flagged", "days_since_first",
        "days_since_prev", "days_since_prev_opp", rd("total_duration", 2).alias("total_duration"),
        rd("p_side").alias("p_side"), rd("y_pred").alias("y_pred"),
        rd("stake_side", 8).alias("stake_side"), rd("stake_opp", 8).alias("stake_opp"))
