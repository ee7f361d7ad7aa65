"""Creations under review and preference records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import stable_id

# The states of a creation; only the first may be reviewed.
CREATION_STATES = ["submetida", "aprovada", "rejeitada"]


def review_creations(creations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """O-W37: id, status, promised_uid, refused.

    A verdict (id, approve) on a creation that is not submitted is refused and changes nothing;
    the uid that the corpus will give is promised on approval alone. Of several verdicts a refusal counts.
    """
    told = verdicts.groupBy("id").agg(F.min("approve").alias("approve"))
    open_ = F.col("status") == CREATION_STATES[0]
    decided = F.when(F.col("approve"), CREATION_STATES[1]).otherwise(CREATION_STATES[2])
    return creations.select("id", "status").join(told, "id", "left").select(
        "id",
        F.when(open_ & F.col("approve").isNotNull(), decided).otherwise(F.col("status")).alias("status"),
        F.when(open_ & F.col("approve"), stable_id(F.lit("plataforma"), F.col("id").cast("string"), F.lit(""))).alias("promised_uid"),
        (F.col("approve").isNotNull() & ~open_).alias("refused"),
    )


def preference_pairs(rounds: DataFrame, turns: DataFrame) -> DataFrame:
    """O-W14: conv_id, round, chosen, rejected, chosen_label, context.

    ``rounds`` has conv_id, round, answer_a, answer_b, winner. Ties and rounds that lack an
    answer give no pair. The context is every turn before the round, in order, a line each.
    """
    first = F.col("winner") == "A"
    won = rounds.filter(F.col("winner").isin("A", "B") & F.col("answer_a").isNotNull() & F.col("answer_b").isNotNull())
    pairs = won.select("conv_id", "round", F.when(first, F.col("answer_a")).otherwise(F.col("answer_b")).alias("chosen"), F.when(first, F.col("answer_b")).otherwise(F.col("answer_a")).alias("rejected"), F.col("winner").alias("chosen_label"))
    lines = turns.select("conv_id", "turn", F.struct("turn", "role", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line")).alias("said"))
    before = pairs.select("conv_id", "round").join(lines, "conv_id").filter("turn < round").groupBy("conv_id", "round").agg(F.sort_array(F.collect_list("said")).alias("said"))
    return pairs.join(before, ["conv_id", "round"], "left").select("conv_id", "round", "chosen", "rejected", "chosen_label", F.coalesce(F.array_join(F.transform("said", lambda x: x["line"]), "\n"), F.lit("")).alias("context"))
