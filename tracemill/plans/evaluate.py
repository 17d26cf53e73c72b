"""From cached scores and student scores to losses per batch and per split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill import fixed
from tracemill.operators.batching import assign_batches, shuffled_index, split_train_val
from tracemill.operators.divergence import (
    batch_loss,
    chosen_mask,
    gather_student,
    gather_student_chunks,
    mean_of_batches,
    position_kl,
    sample_sums,
)
from tracemill.operators.ordering import hash_index
from tracemill.operators.tokens import truncate_positions
from tracemill.sources.score_store import ScoreStore


def assign_epoch(
    trajectory_ids: DataFrame, epoch: int, batch_size: int, fraction: float = fixed.VALIDATION_FRACTION, seed: int = fixed.SEED
) -> DataFrame:
    """(trajectory_id, split, batch_id, slot) of one epoch: split, then order and batch each side.

    Training is shuffled anew in every epoch; validation keeps one order, so that its mean over
    batches can be compared between epochs.
    """
    split = split_train_val(trajectory_ids, fraction=fraction, seed=seed)
    train = shuffled_index(split.where("split = 'train'"), epoch, seed=seed)
    held_out = hash_index(split.where("split = 'val'"), "trajectory_id", str(seed), name="idx", total="_n").drop("_n")
    return assign_batches(train.unionByName(held_out), batch_size).drop("idx")


def evaluate(
    cache: DataFrame,
    student: DataFrame,
    assignment: DataFrame,
    *,
    temperature: float = 1.0,
    max_tokens: int = fixed.MAX_TRAJECTORY_TOKENS,
    shift: int = 0,
) -> DataFrame:
    """Mean batch loss per split. Where no loss mask was stored, all positions count."""
    sums = trajectory_sums(cache, student, temperature=temperature, max_tokens=max_tokens, shift=shift)
    return mean_losses(sums, assignment)


def trajectory_sums(
    cache: DataFrame,
    student: DataFrame,
    *,
    temperature: float = 1.0,
    max_tokens: int = fixed.MAX_TRAJECTORY_TOKENS,
    shift: int = 0,
) -> DataFrame:
    """Summed losses of each trajectory: what ``mean_losses`` needs for any number of assignments."""
    masked = _masked(truncate_positions(cache, max_tokens))
    return sample_sums(position_kl(gather_student(masked, student, shift=shift), temperature))


def evaluate_store(
    store: ScoreStore,
    student: DataFrame,
    assignment: DataFrame,
    *,
    temperature: float = 1.0,
    max_tokens: int = fixed.MAX_TRAJECTORY_TOKENS,
    shift: int = 0,
) -> DataFrame:
    """``evaluate`` on a compacted store, whose rows are not moved."""
    version = store.snapshot()
    gathered = gather_student_chunks(store.chunks(version), student, shift=shift, buckets=version.buckets)
    return mean_losses(sample_sums(position_kl(_masked(truncate_positions(gathered, max_tokens)), temperature)), assignment)


def _masked(positions: DataFrame) -> DataFrame:
    return positions.withColumn("loss_mask", chosen_mask(F.col("loss_mask"), F.lit(1)))


def mean_losses(sums: DataFrame, assignment: DataFrame) -> DataFrame:
    """Mean batch loss per split from one row of sums per trajectory; one without a batch is an error."""
    sums = sums.join(assignment, "trajectory_id", "left")
    problem = F.raise_error(F.concat(F.lit("no batch for trajectory "), "trajectory_id")).cast("bigint")
    placed = sums.withColumn("batch_id", F.when(F.col("batch_id").isNull(), problem).otherwise(F.col("batch_id")))
    return mean_of_batches(batch_loss(placed, ["split", "batch_id"]), ["split"])
