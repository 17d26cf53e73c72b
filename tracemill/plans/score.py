"""Building the score cache: skip, render, tokenize, score, mask, write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill import fixed
from tracemill.functions.text import PLAIN, Template
from tracemill.operators.filters import min_chars
from tracemill.operators.render import locate_parts, prompt_boundary, whole_texts
from tracemill.operators.scores import Scorer, cache_positions, score_with, split_by_status
from tracemill.operators.scoring import BATCH_TOKENS, cache_rows, score_arrays
from tracemill.operators.tokens import Encoder, assemble_samples, boundary_token, encode, explode_tokens, tokenize_with
from tracemill.session import materialise
from tracemill.sources.score_cache import not_cached, write_cache
from tracemill.sources.score_store import ScoreStore, Snapshot


def build_samples(
    messages: DataFrame,
    dictionary: DataFrame | None,
    *,
    template: Template = PLAIN,
    minimum_chars: int = fixed.MIN_CHARS,
    max_tokens: int = fixed.MAX_TRAJECTORY_TOKENS,
    unk_id: int | None = None,
    make_encoder: Callable[[], Encoder] | None = None,
) -> DataFrame:
    """Messages to (trajectory_id, input_ids, loss_mask, prompt_boundary).

    With ``make_encoder`` the user's tokenizer sees each whole rendered text, and ``dictionary``
    is not used. Otherwise tokens outside the dictionary get ``unk_id``, or are an error.
    """
    # Read by the tokens and by the boundaries: written once instead of located twice.
    parts = materialise(min_chars(locate_parts(messages, template), minimum=minimum_chars), "parts")
    if make_encoder is not None:
        rows = tokenize_with(whole_texts(parts, template), make_encoder, max_tokens=max_tokens, ranges="assistant_ranges")
        boundary = boundary_token(F.col("tok_starts"), F.col("prompt_boundary_char"))
        return rows.select("trajectory_id", "input_ids", "loss_mask", boundary.alias("prompt_boundary"))
    tokens = explode_tokens(parts, template, offsets=False, max_tokens=max_tokens)
    samples = assemble_samples(encode(tokens, dictionary, unk_id), max_tokens)
    boundaries = prompt_boundary(parts).select("trajectory_id", "prompt_boundary")
    # Both sides are partitioned by trajectory already.
    return samples.join(boundaries.hint("merge"), "trajectory_id").withColumn(
        "prompt_boundary", F.least("prompt_boundary", F.size("input_ids")).cast("int")
    )


def build_cache(
    messages: DataFrame,
    dictionary: DataFrame | None,
    path: str,
    make_scorer: Callable[[], Scorer],
    *,
    run_id: str | None = None,
    batch_size: int = fixed.SCORER_BATCH,
    top_k: int = fixed.TOP_K,
    score_format: str = fixed.LOGPROBS,
    minimum_chars: int = fixed.MIN_CHARS,
    max_tokens: int = fixed.MAX_TRAJECTORY_TOKENS,
    template: Template = PLAIN,
    partitions: int | None = None,
    unk_id: int | None = None,
    make_encoder: Callable[[], Encoder] | None = None,
) -> DataFrame:
    """Score every trajectory that is not in the cache yet and append it.

    Returns the trajectories that could not be scored. Run again to resume; call it on one slice
    of the trajectories after another to save work in between.
    """
    samples = build_samples(
        not_cached(messages, path),
        dictionary,
        template=template,
        minimum_chars=minimum_chars,
        max_tokens=max_tokens,
        unk_id=unk_id,
        make_encoder=make_encoder,
    )
    # Scores are the costly step: written once, then split into cache rows and failures.
    scored = score_with(samples, make_scorer, batch_size, top_k=top_k, partitions=partitions)
    good, failed = split_by_status(materialise(scored, "scored"))
    write_cache(cache_positions(good, top_k, score_format), path, run_id)
    return failed


def build_store(
    messages: DataFrame,
    dictionary: DataFrame | None,
    store: ScoreStore,
    make_scorer: Callable[[], Scorer],
    *,
    run_id: str | None = None,
    batch_tokens: int = BATCH_TOKENS,
    batch_size: int = fixed.SCORER_BATCH,
    top_k: int = fixed.TOP_K,
    score_format: str = fixed.LOGPROBS,
    partitions: int | None = None,
    **sampling,
) -> Snapshot:
    """Score every trajectory that the store lacks and append one run.

    Scores are written once, as arrays. What could not be scored is in the store's quarantine, and is
    tried again by the next call. ``sampling`` goes to ``build_samples``.
    """
    samples = build_samples(store.missing(messages), dictionary, **sampling)
    scored = score_arrays(
        samples, make_scorer, max_tokens=batch_tokens, max_sequences=batch_size, top_k=top_k, partitions=partitions
    )
    return store.append(cache_rows(scored, score_format), run_id)
