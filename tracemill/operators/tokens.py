"""Tokens, token dictionary, loss masks and prompt windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill import fixed
from tracemill.functions.arrays import fit_length, running_sum
from tracemill.functions.text import PLAIN, Template, token_list
from tracemill.operators.lookup import lookup
from tracemill.operators.ordering import ordered_index

Encoder = Callable[[list[str]], list[tuple[list[int], list[tuple[int, int]]]]]
#: Characters of the texts of one call of a user's tokenizer.
SLICE_CHARS = 262_144


def explode_tokens(
    parts: DataFrame, template: Template = PLAIN, *, offsets: bool = True, max_tokens: int | None = None
) -> DataFrame:
    """One row per token of a parts table under the default tokenizer; no shuffle.

    Columns: trajectory_id, pos, token, loss_mask; tok_start and tok_end if ``offsets``;
    prev_token if ``parts`` has it. A part brings its own tokens and those of the separator
    before it. The mask needs no overlap test here, since no token reaches over a part's edge:
    it is 1 on the tokens of assistant parts. ``max_tokens`` truncates each trajectory.
    """
    previous = "prev_token" in parts.columns
    follows = F.col("char_start") > 0
    gap = F.when(follows, template.separator_tokens).otherwise(0)
    if max_tokens is not None:
        parts = parts.filter(F.col("tok_start") - gap < max_tokens)
    segment = F.concat(F.when(follows, F.lit(template.separator)).otherwise(F.lit("")), F.col("part"))
    # All that can be is worked out per part, before rows multiply.
    kept = {
        "trajectory_id": F.col("trajectory_id"),
        "_first": F.col("tok_start") - gap,
        "_masked_from": F.when(F.col("role") == "assistant", gap),
    }
    if not offsets and not previous:
        # Exploding a column would make Spark filter on it first, and so match the pattern again.
        columns = [column.alias(name) for name, column in kept.items()]
        exploded = parts.select(*columns, F.posexplode(token_list(segment)).alias("_i", "token"))
    else:
        kept["_first_char"] = F.col("char_start") - F.when(follows, len(template.separator)).otherwise(0)
        kept["_tokens"] = token_list(segment)
        if previous:
            kept["prev_token"] = F.col("prev_token")
        listed = parts.select(*(column.alias(name) for name, column in kept.items()))
        columns = [F.col("_tokens").alias("token")]
        if previous:
            shifted = F.concat(F.array("prev_token"), F.slice("_tokens", F.lit(1), F.size("_tokens") - 1))
            columns.append(shifted.alias("prev_token"))
        if offsets:
            # A column of its own, as a generator takes no Python function.
            listed = listed.withColumn("_starts", running_sum(F.col("_tokens"), F.length))
            columns.append(F.col("_starts").alias("start"))
        exploded = listed.select(
            "trajectory_id",
            "_first",
            "_masked_from",
            "_first_char",
            F.posexplode(F.arrays_zip(*columns)).alias("_i", "_t"),
        ).select("*", "_t.*")
    added = ["prev_token"] if previous else []
    if offsets:
        start = F.col("_first_char") + F.col("start")
        added += [start.alias("tok_start"), (start + F.length("token")).alias("tok_end")]
    result = exploded.select(
        "trajectory_id",
        (F.col("_first") + F.col("_i")).cast("int").alias("pos"),
        "token",
        F.coalesce(F.col("_i") >= F.col("_masked_from"), F.lit(False)).cast("int").alias("loss_mask"),
        *added,
    )
    return result if max_tokens is None else result.filter(F.col("pos") < max_tokens)


def token_dictionary(tokens: DataFrame) -> DataFrame:
    """Ids by falling count, ties by token text: (token, n, token_id)."""
    counted = tokens.groupBy("token").agg(F.count("*").alias("n"))
    return ordered_index(counted, [F.desc("n"), F.asc("token")], "token_id").withColumn(
        "token_id", F.col("token_id").cast("int")
    )


def encode(tokens: DataFrame, dictionary: DataFrame, unk_id: int | None = None) -> DataFrame:
    """Add token_id; a token that the dictionary does not hold gets ``unk_id``.

    Without one its id is NULL, which ``assemble_samples`` refuses.
    """
    encoded = lookup(tokens, dictionary.select("token", "token_id"), "token", "token_id")
    if unk_id is None:
        return encoded
    return encoded.withColumn("token_id", F.coalesce("token_id", F.lit(unk_id).cast("int")))


def tokenize_with(
    texts: DataFrame,
    make_encoder: Callable[[], Encoder],
    *,
    max_tokens: int | None = None,
    text: str = "text",
    ranges: str | None = None,
) -> DataFrame:
    """Add input_ids, tok_starts and tok_ends from a tokenizer supplied by the user.

    ``ranges`` names a column of sorted, disjoint (start, end) ranges; it adds loss_mask, 1 for
    each token that overlaps one and 0 for special tokens.

    ``make_encoder`` runs once per task and returns a function from a list of texts to a list of
    (ids, offsets) pairs. Offsets count code points; special tokens have offset (0, 0). A call gets
    texts of ``SLICE_CHARS`` characters at most, or one longer text, so that a task never holds the
    tokens of a whole batch as Python objects.
    """
    schema = T.StructType(
        [
            *texts.schema.fields,
            T.StructField("input_ids", T.ArrayType(T.IntegerType())),
            T.StructField("tok_starts", T.ArrayType(T.IntegerType())),
            T.StructField("tok_ends", T.ArrayType(T.IntegerType())),
            *([T.StructField("loss_mask", T.ArrayType(T.IntegerType()))] if ranges else []),
        ]
    )

    def slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        first, size = 0, 0
        for k, value in enumerate(batch[text]):
            length = len(value or "")
            if size + length > SLICE_CHARS and k > first:
                yield batch.iloc[first:k]
                first, size = k, 0
            size += length
        yield batch.iloc[first:]

    def mask(starts: np.ndarray, ends: np.ndarray, spans) -> np.ndarray:
        s, e = starts.astype(np.int64), ends.astype(np.int64)
        if spans is None or not len(spans):
            return np.zeros(len(s), np.int32)
        opened = np.array([x["start"] for x in spans], np.int64)
        closed = np.array([x["end"] for x in spans], np.int64)
        before = np.searchsorted(opened, e, side="left")
        last = closed[np.maximum(before, 1) - 1]
        return ((e > 0) & (before > 0) & (last > s)).astype(np.int32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            for part in slices(batch):
                ids, starts, ends = [], [], []
                for token_ids, offsets in encoder(part[text].tolist()):
                    spans = np.array(offsets[:max_tokens], np.int32).reshape(-1, 2)
                    ids.append(np.array(token_ids[:max_tokens], np.int32))
                    starts.append(spans[:, 0])
                    ends.append(spans[:, 1])
                added = {"input_ids": ids, "tok_starts": starts, "tok_ends": ends}
                if ranges:
                    added["loss_mask"] = [mask(*row) for row in zip(starts, ends, part[ranges])]
                yield part.assign(**added)

    return texts.mapInPandas(run, schema)


def encode_texts(encoder: Encoder, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of tokens of each text, and ids, starts and ends of all; calls are as large as those of ``tokenize_with``."""
    counts, ids, spans = [], [np.zeros(0, np.int32)], [np.zeros((0, 2), np.int32)]
    first, size = 0, 0
    for k in range(len(texts) + 1):
        if first < k and (k == len(texts) or size + len(texts[k]) > SLICE_CHARS):
            found = encoder(texts[first:k])
            if len(found) != k - first:
                raise ValueError(f"{len(found)} answers for {k - first} texts")
            for token_ids, offsets in found:
                counts.append(len(token_ids))
                ids.append(np.array(token_ids, np.int32))
                spans.append(np.array(offsets, np.int32).reshape(-1, 2))
            first, size = k, 0
        if k < len(texts):
            size += len(texts[k])
    starts, ends = np.concatenate(spans).astype(np.int64).T
    return np.array(counts, np.int64), np.concatenate(ids), starts, ends


def overlaps(
    at: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, opened: np.ndarray, closed: np.ndarray
) -> np.ndarray:
    """1 for each token (of text ``at``) that overlaps a range of its text, 0 for the rest and for special tokens.

    Ranges (of text ``row``) are sorted and disjoint.
    """
    if not len(opened) or not len(at):
        return np.zeros(len(at), np.int32)
    stride = max(int(ends.max()), int(closed.max())) + 2
    before = np.searchsorted(row * stride + opened, at * stride + ends, side="left")
    some = before > np.searchsorted(row, at, side="left")
    return ((ends > 0) & some & (closed[np.maximum(before, 1) - 1] > starts)).astype(np.int32)


def overlap_mask(starts: Column, ends: Column, ranges: Column) -> Column:
    """1 for each token that overlaps a range, 0 for the rest and for special tokens (end 0).

    For rows that carry offsets of any tokenizer. ``ranges`` must be a plain column, such as the
    output of ``tokenize_with``: it is read once per token.
    """
    return F.zip_with(
        starts,
        ends,
        lambda start, end: (
            (end > 0) & F.exists(ranges, lambda r: (start < r["end"]) & (end > r["start"]))
        ).cast("int"),
    )


def boundary_token(starts: Column, boundary_char: Column) -> Column:
    """First position whose token starts at or after the boundary, else the number of tokens."""
    boundaries = F.array_repeat(boundary_char, F.size(starts))
    at_or_after = F.zip_with(starts, boundaries, lambda start, boundary: start >= boundary)
    first = F.array_position(at_or_after, True)
    return F.when(first > 0, first - 1).otherwise(F.size(starts)).cast("int")


def valid_mask(positions: DataFrame) -> DataFrame:
    """Mark positions that have scores and take the others out of the loss."""
    valid = F.col("top_ids").isNotNull().cast("int")
    return positions.withColumn("is_valid", valid).withColumn("loss_mask", F.col("loss_mask") * valid)


def align_mask(mask: Column, length: Column) -> Column:
    """Stored mask brought to the sequence length; an absent one becomes all ones."""
    return F.when(mask.isNull(), F.array_repeat(F.lit(1), length)).otherwise(fit_length(mask, length, 0))


def truncate(values: Column, max_tokens: int) -> Column:
    return F.slice(values, 1, max_tokens)


def truncate_positions(positions: DataFrame, max_tokens: int) -> DataFrame:
    return positions.filter(F.col("pos") < max_tokens)


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def prompt_window(
    ids: Column, mask: Column, max_prompt: int = fixed.MAX_PROMPT_TOKENS, boundary: Column | None = None, pad_id: int = fixed.PAD_ID
) -> tuple[Column, Column]:
    """Prompt ids and mask, cut at the boundary and filled up to ``max_prompt``.

    Without a boundary (no column, or NULL) the first ``max_prompt`` tokens are the prompt.
    """
    limit = F.lit(max_prompt)
    if boundary is not None:
        limit = F.least(F.coalesce(boundary, F.lit(max_prompt)), F.lit(max_prompt))
    return (
        fit_length(F.slice(ids, F.lit(1), limit), max_prompt, pad_id),
        fit_length(F.slice(mask, F.lit(1), limit), max_prompt, 0),
    )


def assemble_samples(tokens: DataFrame, max_tokens: int = fixed.MAX_TRAJECTORY_TOKENS) -> DataFrame:
    """Token rows (trajectory_id, pos, token_id, loss_mask) to one row of arrays per trajectory.

    Truncation comes first, so that no group holds more than ``max_tokens`` rows. Position, id
    and mask travel as one BIGINT (31 + 32 + 1 bits) that sorts by position. A NULL id is an
    error: leaving its token out would shift all later ones.
    """
    if max_tokens < 1:
        raise ValueError("max_tokens must be positive")
    unknown = F.raise_error(F.lit("a token is not in the dictionary; pass unk_id")).cast("bigint")
    token_id = F.coalesce(F.col("token_id").cast("bigint"), unknown)
    packed = (
        F.shiftleft(F.col("pos").cast("bigint"), 32)
        + F.shiftleft(token_id, 1)
        + F.col("loss_mask")
    )
    return (
        truncate_positions(tokens, max_tokens)
        .groupBy("trajectory_id")
        .agg(F.sort_array(F.collect_list(packed)).alias("_packed"))
        .select(
            "trajectory_id",
            F.transform("_packed", lambda p: F.shiftright(p.bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")).alias("input_ids"),
            F.transform("_packed", lambda p: p.bitwiseAND(F.lit(1)).cast("int")).alias("loss_mask"),
        )
        .withColumn("attention_mask", attention_mask(F.col("input_ids")))
    )
