"""Split, shuffle, batches and padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill import fixed
from tracemill.functions.arrays import fit_length
from tracemill.operators.ordering import hash_index, ordered_index
from tracemill.operators.scores import score_format



def split_train_val(
    df: DataFrame,
    key: str = "trajectory_id",
    fraction: float = fixed.VALIDATION_FRACTION,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Add ``split`` (train or val). Exactly max(1, int(n * fraction)) rows are val.

    Repeatable: the rows with the smallest md5(seed:key) are held out.
    """
    indexed = hash_index(df, key, str(seed), name="_idx", total="_n")
    n_val = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(fraction))))
    split = F.when(F.col("_idx") < n_val, F.lit("val")).otherwise(F.lit("train"))
    return indexed.withColumn("split", split).drop("_idx", "_n")


def split_overlap(df: DataFrame, column: str = "instance_id") -> DataFrame:
    """How many values of ``column`` there are, and how many occur on both sides of the split."""
    sides = df.groupBy(column).agg((F.min("split") != F.max("split")).alias("_shared"))
    return sides.agg(F.count("*").alias("n_values"), F.count_if("_shared").alias("n_shared"))


def sample_index(df: DataFrame, key: str = "trajectory_id", name: str = "idx") -> DataFrame:
    """Number the rows in key order. Pass narrow rows."""
    return ordered_index(df, [key], name)


def shuffled_index(
    df: DataFrame,
    epoch: int,
    key: str = "trajectory_id",
    seed: int = fixed.SEED,
    name: str = "idx",
    within: Sequence[str] = (),
) -> DataFrame:
    """Number the rows in an order that changes with the epoch and is otherwise repeatable.

    ``within`` numbers each side of a split on its own.
    """
    return hash_index(df, key, f"{seed}:{epoch}", name=name, total="_n", within=within).drop("_n")


def assign_batches(df: DataFrame, batch_size: int, idx: str = "idx") -> DataFrame:
    """Add batch_id and slot; the last batch may be short."""
    return df.withColumn("batch_id", F.floor(F.col(idx) / batch_size)).withColumn(
        "slot", (F.col(idx) % batch_size).cast("int")
    )


def _target_length(ids: Column, max_length: int | None, keys: Sequence[str]) -> Column:
    # A batch has batch_size rows, so this window's groups are bounded.
    longest = F.max(F.size(ids)).over(Window.partitionBy(*keys))
    return F.least(longest, F.lit(max_length)) if max_length else longest


def pad_batch(
    samples: DataFrame, *, pad_id: int = fixed.PAD_ID, max_length: int | None = None, keys: Sequence[str] = ("batch_id",)
) -> DataFrame:
    """Bring input_ids, attention_mask and, if present, loss_mask to one length per batch.

    That length is the longest sample's, capped by ``max_length`` unless it is None or 0; it is
    added as ``batch_max_len``.
    """
    padded = samples.withColumn("batch_max_len", _target_length(F.col("input_ids"), max_length, keys))
    fills = {"input_ids": pad_id, "attention_mask": 0, "loss_mask": 0}
    for name, fill in fills.items():
        if name in samples.columns:
            padded = padded.withColumn(name, fit_length(F.col(name), F.col("batch_max_len"), fill))
    return padded


def pad_scores(samples: DataFrame, k: int, length: str = "batch_max_len") -> DataFrame:
    """Bring teacher_values and teacher_indices ([len, k] arrays) to the batch length with zero rows."""
    empty_values = F.array_repeat(F.lit(0.0).cast("float"), k)
    empty_ids = F.array_repeat(F.lit(0), k)
    return samples.withColumn(
        "teacher_values", fit_length(F.col("teacher_values"), F.col(length), empty_values)
    ).withColumn("teacher_indices", fit_length(F.col("teacher_indices"), F.col(length), empty_ids))


def batch_metadata(samples: DataFrame) -> DataFrame:
    """Format, score width and presence of masks per batch, and whether they agree.

    A NULL format is that of a cache without a tag.
    """
    width = F.size(F.get(F.col("teacher_values"), F.lit(0)))
    masked = F.col("loss_mask").isNotNull()
    samples = samples.withColumn("format", score_format(F.col("format")))
    return samples.groupBy("batch_id").agg(
        F.min("format").alias("format"),
        F.min(width).alias("top_k"),
        F.bool_and(masked).alias("has_loss_mask"),
        (
            (F.min("format") == F.max("format"))
            & (F.min(width).eqNullSafe(F.max(width)))
            & (F.bool_and(masked) == F.bool_or(masked))
        ).alias("is_uniform"),
    )


def require_uniform(metadata: DataFrame) -> DataFrame:
    """Fail on a batch that mixes formats, score widths or presence of masks."""
    message = F.concat(F.lit("batch "), F.col("batch_id").cast("string"), F.lit(" mixes score formats or widths"))
    checked = F.when(F.col("is_uniform"), F.col("format")).otherwise(F.raise_error(message).cast("string"))
    return metadata.withColumn("format", checked)
