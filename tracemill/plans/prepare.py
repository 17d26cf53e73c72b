"""From raw trajectories to the gold set, with counts; and the tokenize-only path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill import fixed
from tracemill.functions.text import PLAIN, Template
from tracemill.operators.filters import first_n, gold, min_tokens, with_messages
from tracemill.operators.profile import message_profile
from tracemill.operators.render import explode_parts, normalise_trajectories, render_trajectories
from tracemill.operators.tokens import (
    Encoder,
    assemble_samples,
    attention_mask,
    encode,
    explode_tokens,
    token_dictionary,
    tokenize_with,
)
from tracemill.session import materialise
from tracemill.sources.trajectories import load_gold, write_gold


def prepare_gold(trajectories: DataFrame, path: str, max_samples: int | None = None) -> DataFrame:
    """Filter to gold, limit, write, and profile what was written."""
    write_gold(first_n(gold(trajectories), max_samples), path)
    stored = load_gold(trajectories.sparkSession, path)
    return message_profile(stored, F.size("trajectory"))


def tokenize_trajectories(
    trajectories: DataFrame,
    *,
    template: Template = PLAIN,
    tool_role_supported: bool = False,
    max_tokens: int = fixed.MAX_TRAJECTORY_TOKENS,
    minimum_tokens: int = fixed.MIN_TOKENS,
    only_gold: bool = True,
    make_encoder: Callable[[], Encoder] | None = None,
) -> DataFrame:
    """Gold trajectories to tokenized samples, tool calls and tool answers written out.

    Samples with fewer than ``minimum_tokens`` tokens after truncation are dropped. Ids come from
    the user's tokenizer, or else from the dictionary of the tokens kept. ``only_gold=False``
    takes all trajectories.
    """
    kept = with_messages(gold(trajectories) if only_gold else trajectories)
    rendered = render_trajectories(normalise_trajectories(kept, tool_role_supported), template)
    names = kept.select(
        "trajectory_id",
        F.coalesce("instance_id", F.lit("")).alias("instance_id"),
        F.coalesce("repo", F.lit("")).alias("repo"),
    )
    if make_encoder is not None:
        texts = rendered.select("trajectory_id", "text")
        samples = tokenize_with(texts, make_encoder, max_tokens=max_tokens).where(
            F.size("input_ids") >= minimum_tokens
        )
        samples = samples.withColumn("attention_mask", attention_mask(F.col("input_ids")))
        return samples.join(names, "trajectory_id").select(
            "input_ids", "attention_mask", "instance_id", "repo", "trajectory_id"
        )
    parts = min_tokens(explode_parts(rendered, template), minimum=minimum_tokens, max_tokens=max_tokens)
    # Read by the dictionary and by the samples: written once instead of rendered twice.
    parts = materialise(parts, "parts")
    tokens = explode_tokens(parts, template, offsets=False, max_tokens=max_tokens)
    samples = assemble_samples(encode(tokens, token_dictionary(tokens)), max_tokens)
    return samples.join(names, "trajectory_id").select(
        "input_ids", "attention_mask", "instance_id", "repo", "trajectory_id"
    )
