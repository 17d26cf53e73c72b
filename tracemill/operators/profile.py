"""Counts over trajectories and running metrics over training steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.filters import is_gold
from tracemill.operators.ordering import running


def message_profile(counts: DataFrame, n_messages: Column | str = "n_messages") -> DataFrame:
    """Smallest, largest and mean number of messages; NULL for no rows."""
    n = F.col(n_messages) if isinstance(n_messages, str) else n_messages
    return counts.agg(
        F.min(n).cast("bigint").alias("min_messages"),
        F.max(n).cast("bigint").alias("max_messages"),
        F.avg(n).alias("avg_messages"),
    )


def funnel(df: DataFrame, processed: Column) -> DataFrame:
    """Total, gold and processed rows in one pass; ``processed`` counts only among gold rows."""
    gold = F.coalesce(is_gold(), F.lit(False))
    kept = gold & F.coalesce(processed, F.lit(False))

    def count_of(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0).cast("bigint"))

    return df.agg(
        F.count("*").alias("n_total"), count_of(gold).alias("n_gold"), count_of(kept).alias("n_processed")
    )


def running_loss(steps: DataFrame, every: int = 10, accumulation_steps: int = 1) -> DataFrame:
    """Mean loss since the start of the epoch, kept at every N-th step that ends an accumulation.

    ``steps`` is (run_id, epoch, step, loss); ``step`` counts from 0 within the epoch.
    """
    earlier = running(
        steps,
        ["run_id", "epoch"],
        "step",
        before={"_loss": ("sum", F.col("loss")), "_steps": ("sum", F.lit(1))},
    )
    mean = (F.col("_loss") + F.col("loss")) / (F.col("_steps") + 1)
    return (
        earlier.withColumn("avg_loss", mean)
        .drop("_loss", "_steps")
        .filter(((F.col("step") + 1) % every == 0) & ((F.col("step") + 1) % accumulation_steps == 0))
    )


def exact_losses(steps: DataFrame) -> DataFrame:
    """(run_id, epoch, val_loss): mean loss of every epoch, the same bits under any partitioning.

    Losses are summed as decimals of 18 places, so equal epochs have equal means and ``new_best``,
    which asks for strictly smaller ones, does not depend on the order of the rows. NULL losses do
    not count; an epoch with only these has none. An infinite loss, NaN, or one of 10 digits or more
    before the point makes the mean of its epoch a plain one.
    """
    exact = F.col("loss").try_cast("decimal(28,18)")
    total, n = F.sum(exact), F.count("loss")
    mean = F.when(F.count(exact) == n, total.cast("double") / n).otherwise(F.avg("loss"))
    return steps.groupBy("run_id", "epoch").agg(F.when(n > 0, mean).alias("val_loss"))


def new_best(epochs: DataFrame) -> DataFrame:
    """Mark epochs whose val_loss is strictly below every earlier one of the run."""
    earlier = running(epochs, ["run_id"], "epoch", before={"_best": ("min", F.col("val_loss"))})
    return earlier.withColumn(
        "is_best", F.col("val_loss") < F.coalesce(F.col("_best"), F.lit(float("inf")))
    ).drop("_best")


def every_nth_epoch(epochs: DataFrame, n: int) -> DataFrame:
    return epochs.filter((F.col("epoch") + 1) % n == 0)
