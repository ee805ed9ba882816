"""Votes that keep arriving: running consensus and resumable annotation with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R


def running_consensus(votes: DataFrame, late: str = "30 days", least_preserved: int = 2, least_changed: int = 2) -> DataFrame:
    """Consensus per pair over a stream of judgments, to be written in update mode.

    A judgment id counts once within the watermark, however often it is sent; votes later than ``late``
    behind the newest are dropped by the watermark. The same rule as the batch consensus.
    """
    once = votes.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["judgment_id"])
    label = R.vote(F.col("label"))
    sums = once.groupBy("pair_id").agg(F.count_if(label == "preserved").alias("votes_p"), F.count_if(label == "changed").alias("votes_c"))
    decided = (
        F.when((F.col("votes_p") >= least_preserved) & (F.col("votes_c") == 0), "preserved")
        .when((F.col("votes_c") >= least_changed) & (F.col("votes_p") == 0), "changed").otherwise("uncertain")
    )
    return sums.withColumn("label", decided)


def votes_per_window(votes: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Votes per day and provider, final once the watermark has passed the day."""
    return votes.withWatermark("judged_at", late).groupBy(F.window("judged_at", width), "judge_provider").agg(F.count("*").alias("n"))


def annotate_available(rows: DataFrame, annotate, output: str, checkpoint: str):
    """Run ``annotate`` (DataFrame to DataFrame) over everything new in a stream and stop; a rerun goes on where it ended."""
    return annotate(rows).writeStream.format("json").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
