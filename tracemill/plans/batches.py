"""From the stored score cache to padded training batches, whole or in chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill import fixed
from tracemill.functions.arrays import fit_length
from tracemill.operators.batching import pad_batch, pad_scores
from tracemill.operators.tokens import align_mask, attention_mask, prompt_window, truncate_positions


def cached_samples(cache: DataFrame, headers: DataFrame, k: int, max_tokens: int = fixed.MAX_TRAJECTORY_TOKENS) -> DataFrame:
    """One row of arrays per cached trajectory, with the teacher's scores as [length, k].

    Truncation comes first, so that no group holds more than ``max_tokens`` positions. Positions
    with fewer than ``k`` scores are filled with id 0 and score 0.
    """
    row = F.struct("pos", "token_id", "loss_mask", "top_ids", "top_vals")
    no_ids, no_vals = F.array().cast("array<int>"), F.array().cast("array<float>")
    zero = F.lit(0.0).cast("float")
    ids = F.transform("_p", lambda p: p["token_id"])
    stored = F.when(F.col("has_loss_mask"), F.transform("_p", lambda p: p["loss_mask"]))
    return (
        truncate_positions(cache, max_tokens)
        .groupBy("trajectory_id")
        .agg(F.sort_array(F.collect_list(row)).alias("_p"))
        .join(headers.select("trajectory_id", "format", "prompt_boundary", "has_loss_mask"), "trajectory_id")
        .select(
            "trajectory_id",
            "format",
            "prompt_boundary",
            ids.alias("input_ids"),
            attention_mask(F.col("_p")).alias("attention_mask"),
            align_mask(stored, F.size("_p")).alias("loss_mask"),
            F.transform("_p", lambda p: fit_length(F.coalesce(p["top_vals"], no_vals), k, zero)).alias("teacher_values"),
            F.transform("_p", lambda p: fit_length(F.coalesce(p["top_ids"], no_ids), k, 0)).alias("teacher_indices"),
        )
    )


def training_batches(
    cache: DataFrame,
    headers: DataFrame,
    assignment: DataFrame,
    k: int,
    *,
    max_tokens: int = fixed.MAX_TRAJECTORY_TOKENS,
    max_prompt: int = fixed.MAX_PROMPT_TOKENS,
    pad_id: int = fixed.PAD_ID,
    max_length: int | None = None,
) -> DataFrame:
    """Samples of the cache with prompt windows, padded batch by batch and split by split.

    ``assignment`` is (trajectory_id, split, batch_id, slot).
    """
    samples = cached_samples(cache, headers, k, max_tokens)
    ids, mask = prompt_window(
        F.col("input_ids"), F.col("attention_mask"), max_prompt, F.col("prompt_boundary"), pad_id
    )
    windowed = samples.withColumn("prompt_ids", ids).withColumn("prompt_mask", mask)
    placed = windowed.withColumn("n_tokens", F.size("input_ids")).join(assignment, "trajectory_id")
    padded = pad_batch(placed, pad_id=pad_id, max_length=max_length, keys=["split", "batch_id"])
    return pad_scores(padded, k)


def chunk_layout(headers: DataFrame, assignment: DataFrame, max_tokens: int, max_length: int | None = None) -> DataFrame:
    """Every chunk of every slot: its real tokens and its padding, from headers alone.

    A batch is as long as its longest sample, capped by ``max_length``; a slot whose sample is
    shorter has chunks of padding only. Adds n_tokens, n_padding and batch_max_len.
    """
    size = fixed.CHUNK_POSITIONS
    # A batch has batch_size rows, so this window's groups are bounded.
    longest = F.max("_len").over(Window.partitionBy("split", "batch_id"))
    slots = (
        headers.select("trajectory_id", "prompt_boundary", "has_loss_mask", F.least("seq_len", F.lit(max_tokens)).alias("_len"))
        .join(assignment, "trajectory_id")
        .withColumn("batch_max_len", F.least(longest, F.lit(max_length)) if max_length else longest)
    )
    chunks = slots.where("batch_max_len > 0").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("batch_max_len") - 1) / size).cast("int")))
    )

    def within(length):
        return F.greatest(F.least(length - F.col("chunk") * size, F.lit(size)), F.lit(0)).cast("int")

    tokens = within(F.least("_len", "batch_max_len"))
    return chunks.select(
        *assignment.columns,
        "prompt_boundary",
        "has_loss_mask",
        "batch_max_len",
        "chunk",
        tokens.alias("n_tokens"),
        (within(F.col("batch_max_len")) - tokens).alias("n_padding"),
    )


def chunked_batches(
    chunks: DataFrame,
    headers: DataFrame,
    assignment: DataFrame,
    k: int,
    *,
    max_tokens: int = fixed.MAX_TRAJECTORY_TOKENS,
    max_prompt: int = fixed.MAX_PROMPT_TOKENS,
    pad_id: int = fixed.PAD_ID,
    max_length: int | None = None,
) -> DataFrame:
    """``training_batches`` in rows of one chunk, with padding counted instead of written.

    ``chunks`` are chunk rows of a store, which are read where they lie. A row has the real tokens
    of (split, batch_id, slot, chunk), ``n_padding`` positions follow them; the first chunk also has
    the prompt window, which must fit into it. No row is wider than a chunk, however long the
    trajectory.
    """
    if max_prompt > fixed.CHUNK_POSITIONS:
        raise ValueError(f"a prompt window has at most {fixed.CHUNK_POSITIONS} tokens")
    layout = chunk_layout(headers, assignment, max_tokens, max_length)
    # Chunks are ordered by position and start with their own first one.
    rows = F.slice(F.coalesce("rows", F.array().cast(chunks.schema["rows"].dataType)), F.lit(1), F.col("n_tokens"))
    placed = layout.hint("merge").join(chunks.select("trajectory_id", "chunk", "rows"), ["trajectory_id", "chunk"], "left")
    placed = placed.withColumn("_p", rows)
    no_ids, no_vals, zero = F.array().cast("array<int>"), F.array().cast("array<float>"), F.lit(0.0).cast("float")
    stored = F.when(F.col("has_loss_mask"), F.transform("_p", lambda p: p["loss_mask"]))
    out = placed.select(
        "split", "batch_id", "slot", "chunk", "trajectory_id", "batch_max_len", "n_tokens", "n_padding", "prompt_boundary",
        F.transform("_p", lambda p: p["token_id"]).alias("input_ids"),
        align_mask(stored, F.size("_p")).alias("loss_mask"),
        F.transform("_p", lambda p: fit_length(F.coalesce(p["top_vals"], no_vals), k, zero)).alias("teacher_values"),
        F.transform("_p", lambda p: fit_length(F.coalesce(p["top_ids"], no_ids), k, 0)).alias("teacher_indices"),
    )
    ids, mask = prompt_window(
        F.col("input_ids"), attention_mask(F.col("input_ids")), max_prompt, F.col("prompt_boundary"), pad_id
    )
    first = F.col("chunk") == 0
    return (
        out.withColumn("prompt_ids", F.when(first, ids)).withColumn("prompt_mask", F.when(first, mask)).drop("prompt_boundary")
    )
