"""One query per operator, over the whole given tables. Results are scalars only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import fixtures as fx
from tracemill.functions.arrays import as_text
from tracemill.functions.distributions import probabilities, teacher_exponents
from tracemill.functions.text import Template, called_functions, native_arguments, normalise_arguments
from tracemill.operators import batching, divergence, filters, profile, render, scores, scoring, selection, tokens, windows
from tracemill.operators.lookup import lookup
from tracemill.plans import batches
from tracemill.plans.evaluate import assign_epoch, evaluate, evaluate_store, mean_losses, trajectory_sums
from tracemill.plans.prepare import prepare_gold, tokenize_trajectories
from tracemill.plans.score import build_cache, build_samples, build_store
from tracemill.session import fresh_path, materialise, open_files
from tracemill.sources import choose, npz, npz_source, score_cache, tokenized
from tracemill.sources import trajectories as stored
from tracemill.sources.score_store import ScoreStore

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

CHAT = Template(prefix="<|im_start|>{role}\n", suffix="<|im_end|>\n", separator="")
K = 8


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _total(values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def _nested_messages(spark, sf_dir):
    return render.explode_messages(fx.trajectories(spark, sf_dir))


def _samples(spark, sf_dir, max_tokens=8192):
    """Samples of all conversations with ids from their own dictionary."""
    parts = materialise(render.locate_parts(fx.messages(spark, sf_dir)), "parts")
    rows = tokens.explode_tokens(parts, offsets=False)
    samples = tokens.assemble_samples(tokens.encode(rows, tokens.token_dictionary(rows)), max_tokens)
    bounds = render.prompt_boundary(parts).select("trajectory_id", "prompt_boundary")
    return samples.join(bounds.hint("merge"), "trajectory_id")


def _gold_dictionary(spark, sf_dir):
    return tokens.token_dictionary(fx.gold_tokens(spark, sf_dir, offsets=False))


def _dictionary(spark, sf_dir):
    return tokens.token_dictionary(fx.conversation_tokens(spark, sf_dir, offsets=False))


def _gathered(spark, sf_dir):
    return divergence.gather_student(*fx.count_scores(spark, sf_dir, K, by_position=True))


def _kl(spark, sf_dir):
    return divergence.position_kl(_gathered(spark, sf_dir))


def _dense_kl(spark, sf_dir, temperature=2.0):
    teacher, student = fx.dense_scores(spark, sf_dir)
    top = divergence.dense_teacher_positions(teacher, K)
    return divergence.position_kl(divergence.gather_dense(top, student, temperature), temperature)


def _ids(spark, sf_dir):
    return fx.headers(spark, sf_dir).select("trajectory_id")


# ---- sources and sinks ------------------------------------------------------------------


@query
def s1_load_trajectories(spark, sf_dir):
    path = fresh_path(spark, "raw")
    fx.trajectories(spark, sf_dir).write.json(path)
    loaded = stored.load_trajectories(spark, path, "json")
    chars = F.aggregate(
        "trajectory", F.lit(0).cast("bigint"), lambda a, m: a + F.coalesce(F.length(m["content"]), F.lit(0))
    )
    return loaded.select(
        "trajectory_id",
        "instance_id",
        "repo",
        "resolved",
        "exit_status",
        F.size("trajectory").alias("n_messages"),
        chars.alias("n_chars"),
    )


@query
def s1_broken_lines(spark, sf_dir):
    """Every seventh line is cut in half."""
    path = fresh_path(spark, "raw")
    rows = fx.trajectories(spark, sf_dir).select("trajectory_id", F.to_json(F.struct("*")).alias("line"))
    cut = F.when(F.col("trajectory_id").cast("bigint") % 7 == 0, F.expr("substring(line, 1, length(line) div 2)"))
    rows.select(F.coalesce(cut, F.col("line")).alias("value")).write.text(path)
    loaded, broken = stored.load_json_lines(spark, path)
    return loaded.agg(F.count("trajectory_id").alias("n")).withColumn("kind", F.lit("read")).unionByName(
        broken.agg(F.count("line").alias("n")).withColumn("kind", F.lit("broken"))
    )


@query
def s1_checked_ids(spark, sf_dir):
    """Every seventh trajectory has lost its id, and multiples of 3 beside share one."""
    number = F.col("trajectory_id").cast("bigint")
    damaged = F.when(number % 7 == 0, None).when(number % 3 == 0, "shared").otherwise(F.col("trajectory_id"))
    rows = fx.trajectories(spark, sf_dir).withColumn("trajectory_id", damaged)
    sound, faulty = stored.split_by_id(rows)
    return (
        sound.withColumn("id_fault", F.lit("none"))
        .unionByName(faulty)
        .select("instance_id", "trajectory_id", "id_fault", F.size("trajectory").alias("n_messages"))
    )


@query
def s2_load_gold(spark, sf_dir):
    path = fresh_path(spark, "gold")
    stored.write_gold(filters.gold(fx.trajectories(spark, sf_dir)), path)
    rows = render.explode_messages(stored.load_gold(spark, path))
    return rows.select(
        "trajectory_id",
        "msg_idx",
        "role",
        "name",
        F.length("content").alias("n_chars"),
        F.size("tool_calls").alias("n_calls"),
    )


@query
def s3_write_gold(spark, sf_dir):
    path = fresh_path(spark, "gold")
    prepare_gold(fx.trajectories(spark, sf_dir), path)
    return stored.load_gold(spark, path).select(
        "trajectory_id",
        "instance_id",
        "repo",
        "resolved",
        "exit_status",
        F.size("trajectory").alias("n_messages"),
    )


def _stored_samples(spark, sf_dir):
    path = fresh_path(spark, "tokenized")
    tokenized.write_tokenized(tokenize_trajectories(fx.trajectories(spark, sf_dir)), path)
    return tokenized.read_tokenized(spark, path)


@query
def s4_write_tokenized(spark, sf_dir):
    return _stored_samples(spark, sf_dir).select(
        "trajectory_id",
        "instance_id",
        "repo",
        F.size("input_ids").alias("n_tokens"),
        as_text(F.col("input_ids")).alias("input_ids"),
    )


@query
def s4_user_tokenizer(spark, sf_dir):
    """All documents through a tokenizer of the user's."""
    path = fresh_path(spark, "tokenized")
    samples = tokenize_trajectories(
        fx.trajectories(spark, sf_dir), only_gold=False, make_encoder=fx.word_encoder()
    )
    tokenized.write_tokenized(samples, path)
    return tokenized.read_tokenized(spark, path).select(
        "trajectory_id", F.size("input_ids").alias("n_tokens"), as_text(F.col("input_ids")).alias("input_ids")
    )


@query
def s5_read_tokenized(spark, sf_dir):
    return _stored_samples(spark, sf_dir).select("trajectory_id", F.size("attention_mask").alias("n_tokens"))


def _counted_cache(spark, sf_dir, runs=("counts",)):
    path = fresh_path(spark, "cache")
    teacher, _ = fx.count_scores(spark, sf_dir, K)
    bounds = render.prompt_boundary(render.locate_parts(fx.messages(spark, sf_dir))).select("trajectory_id", "prompt_boundary")
    rows = tokens.valid_mask(teacher).join(bounds, "trajectory_id")
    if len(runs) > 1:
        # Written by each run: looked up once.
        rows = materialise(rows, "scores")
    for run_id in runs:
        score_cache.write_cache(rows, path, run_id)
    return path


@query
def s6_write_cache(spark, sf_dir):
    return score_cache.read_headers(spark, _counted_cache(spark, sf_dir))


@query
def s7_read_cache(spark, sf_dir):
    return score_cache.read_cache(spark, _counted_cache(spark, sf_dir), "logprobs").select(
        "trajectory_id",
        "chunk",
        "pos",
        "token_id",
        "loss_mask",
        "is_valid",
        as_text(F.col("top_ids")).alias("top_ids"),
        F.round(_total("top_vals"), 4).alias("val_sum"),
    )


@query
def s7_two_runs(spark, sf_dir):
    """Every trajectory is cached by two runs; one of them counts."""
    path = _counted_cache(spark, sf_dir, ("counts", "later"))
    rows = score_cache.read_cache(spark, path).groupBy("trajectory_id").agg(F.count("*").alias("n_positions"))
    runs = score_cache.read_headers(spark, path).select("trajectory_id", "run_id")
    return rows.join(runs, "trajectory_id")


@query
def s8_npz_import(spark, sf_dir):
    return npz.decode_npz(fx.archives(spark, sf_dir)).select(
        "trajectory_id",
        "chunk",
        "pos",
        "token_id",
        "loss_mask",
        "prompt_boundary",
        "format",
        as_text(F.col("top_ids")).alias("top_ids"),
        as_text(F.transform("top_vals", lambda v: (v * 64).cast("int"))).alias("top_vals"),
    )


@query
def s8_npz_files(spark, sf_dir):
    """Archives written by tasks to the shared folder and read again through the data source."""
    vectors = fx.table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 50).cast("string").alias("trajectory_id"),
        F.lit(0).alias("chunk"),
        (F.col("vec_id") % 50).alias("pos"),
        F.col("label").alias("token_id"),
        (F.col("label") % 2).alias("loss_mask"),
        F.lit("logits").alias("format"),
        F.sequence(F.lit(0), F.size("embedding") - 1).alias("top_ids"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 64) / 64).alias("top_vals"),
    )
    sizes = vectors.groupBy("trajectory_id").agg((F.count("*") / 2).cast("int").alias("prompt_boundary"))
    folder = fresh_path(spark, "archives")
    npz_source.write_npz(vectors.join(sizes, "trajectory_id"), folder)
    rows = npz_source.read_npz(spark, folder, partition_bytes=100_000)
    return rows.select(
        F.regexp_replace("trajectory_id", "^trajectory_", "").alias("trajectory_id"),
        "chunk",
        "pos",
        "token_id",
        "loss_mask",
        "prompt_boundary",
        "format",
        as_text(F.col("top_ids")).alias("top_ids"),
        as_text(F.transform("top_vals", lambda v: (v * 64).cast("int"))).alias("top_vals"),
    )


@query
def s9_resume(spark, sf_dir):
    """Gold conversations are cached first, then all; a third run finds nothing to do."""
    path = fresh_path(spark, "cache")
    everything = fx.messages(spark, sf_dir)
    dictionary = tokens.token_dictionary(
        tokens.explode_tokens(render.locate_parts(everything), offsets=False)
    )
    scorer = fx.echo_scorer()
    for run_id, part in (
        ("first", fx.gold_messages(spark, sf_dir)),
        ("second", everything),
        ("third", everything),
    ):
        build_cache(part, dictionary, path, scorer, run_id=run_id, top_k=2)
    return score_cache.read_headers(spark, path).select("trajectory_id", "run_id", "seq_len")


@query
def s10_source_choice(spark, sf_dir):
    """Raw data first, then the table that run has written, then the score cache."""
    tokenized_path = fresh_path(spark, "tokenized")
    cache_path = fresh_path(spark, "cache")

    def attempt():
        name, rows = choose.choose_source(
            spark,
            cache_path=cache_path,
            tokenized_path=tokenized_path,
            tokenize_raw=lambda: tokenize_trajectories(fx.trajectories(spark, sf_dir)),
        )
        return rows.agg(F.count_distinct("trajectory_id").alias("n_trajectories")).withColumn(
            "source", F.lit(name)
        )

    first, second = attempt(), attempt()
    build_cache(
        fx.gold_messages(spark, sf_dir), _gold_dictionary(spark, sf_dir), cache_path, fx.echo_scorer(), top_k=2
    )
    return first.unionByName(second).unionByName(attempt())


@query
def s11_cache_summary(spark, sf_dir):
    """Two formats, so two files; beside them the file of a run that died before its headers."""
    path = fresh_path(spark, "cache")
    teacher, _ = fx.count_scores(spark, sf_dir, K)
    even = F.pmod(F.col("trajectory_id").cast("bigint"), F.lit(2)) == 0
    rows = tokens.valid_mask(teacher).withColumn("format", F.when(even, "logits"))
    rows = rows.withColumn("loss_mask", F.when(even, F.col("loss_mask")))
    # Written, as both runs have the same scores.
    rows = materialise(rows, "scores")
    # All tasks write; their files are joined into the two.
    score_cache.write_cache(rows, path, "counts", True)
    with open_files(spark, score_cache.FORMATS):
        rows.write.partitionBy("format").parquet(f"{path}/positions/run_id=dead")
    summary = score_cache.cache_summary(spark, path)
    return summary.select("n_trajectories", "n_without_mask", "n_files", (F.col("total_gb") > 0).alias("has_bytes"))


def _store_rows(spark, sf_dir):
    teacher, student = fx.count_scores(spark, sf_dir, K)
    bounds = render.prompt_boundary(render.locate_parts(fx.messages(spark, sf_dir))).select("trajectory_id", "prompt_boundary")
    return tokens.valid_mask(teacher).join(bounds, "trajectory_id"), student


@query
def s6_compacted_cache(spark, sf_dir):
    """Three runs, the last of which has trajectories of the first again, and one that died; read before
    and after compaction.
    """
    path = fresh_path(spark, "store")
    store = ScoreStore(spark, path)
    rows = materialise(_store_rows(spark, sf_dir)[0], "scores")
    part = F.pmod(F.col("trajectory_id").cast("bigint"), F.lit(3))
    for run, wanted in (("first", part == 0), ("second", part > 0), ("third", part < 2)):
        store.append(rows.where(wanted), run)
    rows.write.parquet(f"{path}/runs/dead/positions")
    before = store.snapshot()
    after = store.compact()

    def sums(snapshot, name):
        return store.positions(snapshot).groupBy("trajectory_id").agg(
            F.count("*").alias(f"n_{name}"),
            F.sum((F.col("pos") + 1) * F.col("token_id").cast("bigint")).alias(f"id_sum_{name}"),
            F.round(F.sum(_total("top_vals")), 3).alias(f"val_sum_{name}"),
        )

    return sums(before, "before").join(sums(after, "after"), "trajectory_id").join(
        store.headers(after).select("trajectory_id", "run_id", "seq_len"), "trajectory_id"
    )


@query
def s11_store_summary(spark, sf_dir):
    """The size by the manifest against the sizes of the files that Spark reads."""
    store = ScoreStore(spark, fresh_path(spark, "store"))
    store.append(_store_rows(spark, sf_dir)[0].withColumn("loss_mask", F.lit(None).cast("int")))
    store.compact()
    files = store.chunks().select("_metadata.file_path", "_metadata.file_size").distinct()
    seen = files.agg(F.count("*").alias("n"), F.sum("file_size").alias("size")).first()
    return store.summary().select(
        "n_trajectories",
        "n_without_mask",
        (F.col("n_files") == F.lit(seen.n)).alias("all_files"),
        (F.round(F.col("total_gb") * 1e9) == F.lit(seen.size)).alias("all_bytes"),
    )


@query
def s13_quarantine(spark, sf_dir):
    samples = build_samples(fx.gold_messages(spark, sf_dir), _gold_dictionary(spark, sf_dir))
    scored = materialise(scores.score_with(samples, fx.echo_scorer(longest=1200)), "scored")
    good, failed = scores.split_by_status(scored)
    kept = good.groupBy("trajectory_id").agg(F.count("*").alias("n_positions"))
    return kept.select(
        "trajectory_id", "n_positions", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error")
    ).unionByName(failed.withColumn("n_positions", F.lit(0).cast("bigint")))


@query
def s13_quarantine_sink(spark, sf_dir):
    """Two attempts with a scorer that refuses long sequences: attempts and last error of each trajectory."""
    store = ScoreStore(spark, fresh_path(spark, "store"))
    rows, dictionary = fx.gold_messages(spark, sf_dir), _gold_dictionary(spark, sf_dir)
    for run in ("first", "second"):
        build_store(rows, dictionary, store, fx.echo_scorer(longest=1200), run_id=run, top_k=2)
    attempts = store.quarantined().groupBy("trajectory_id").agg(
        F.max("attempt").alias("n_attempts"), F.max_by("error", "attempt").alias("error"), F.max_by("run_id", "attempt").alias("run_id")
    )
    cached = store.headers().select("trajectory_id", "seq_len")
    return cached.join(attempts, "trajectory_id", "full").select(
        "trajectory_id", "seq_len", F.coalesce("n_attempts", F.lit(0)).alias("n_attempts"), "error", "run_id"
    )


@query
def s13_malformed_scores(spark, sf_dir):
    """Answers that are missing, NULL, too short or too long; every sequence is accounted for."""
    samples = build_samples(fx.messages(spark, sf_dir), _dictionary(spark, sf_dir))
    scored = materialise(scores.score_with(samples, fx.careless_scorer()), "scored")
    return scored.groupBy("trajectory_id", "status").agg(F.count("pos").alias("n_positions"))


# ---- filters ----------------------------------------------------------------------------


@query
def f1_gold_filter(spark, sf_dir):
    return filters.gold(fx.headers(spark, sf_dir))


@query
def f2_first_n(spark, sf_dir):
    return filters.first_n(filters.gold(fx.headers(spark, sf_dir)), 20).select("trajectory_id", "n_messages")


@query
def f2_selected(spark, sf_dir):
    """The first 20 gold conversations, and the first half of all messages of the corpus by a text key."""
    few = filters.first_n(filters.gold(fx.headers(spark, sf_dir)), 20).select(F.lit("few").alias("part"), "trajectory_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("event-"), F.col("event_id")).alias("trajectory_id")
    )
    half = filters.first_n(rows, rows.count() // 2).select(F.lit("half").alias("part"), "trajectory_id")
    return few.unionByName(half)


@query
def f3_with_messages(spark, sf_dir):
    """Documents without a label count as not recorded (NULL), those of blank lines only as empty."""
    recorded = F.when(F.col("resolved").isNotNull(), F.filter("trajectory", lambda m: m["content"] != ""))
    kept = filters.with_messages(fx.trajectories(spark, sf_dir).withColumn("trajectory", recorded))
    return kept.select("trajectory_id", F.size("trajectory").alias("n_messages"))


@query
def f4_drop_empty_messages(spark, sf_dir):
    kept = filters.drop_empty_messages(_nested_messages(spark, sf_dir))
    return kept.select("trajectory_id", "msg_idx", "role", F.length("content").alias("n_chars"))


@query
def f5_min_chars(spark, sf_dir):
    kept = filters.min_chars(render.locate_parts(fx.messages(spark, sf_dir)), minimum=1000)
    return render.prompt_boundary(kept).select("trajectory_id", "n_chars")


@query
def f6_min_tokens(spark, sf_dir):
    kept = filters.min_tokens(
        render.locate_parts(fx.messages(spark, sf_dir)), minimum=500, max_tokens=512
    )
    return render.prompt_boundary(kept).select(
        "trajectory_id", F.least("n_tokens", F.lit(512)).alias("n_tokens")
    )


@query
def f7_vanished_trajectories(spark, sf_dir):
    kept = filters.drop_empty_messages(_nested_messages(spark, sf_dir))
    return kept.groupBy("trajectory_id").agg(F.count("*").alias("n_kept"))


# ---- messages and rendering -------------------------------------------------------------


@query
def m1_flatten_tool_calls(spark, sf_dir):
    flat = render.flatten_tool_calls(_nested_messages(spark, sf_dir))
    return flat.filter(F.col("role") == "assistant").select("trajectory_id", "msg_idx", "content")


@query
def m2_normalise_arguments(spark, sf_dir):
    raw = F.transform(called_functions(F.col("tool_calls")), lambda function: function["arguments"])
    calls = _nested_messages(spark, sf_dir).withColumn("arguments", normalise_arguments(F.array(raw)))
    return calls.select(
        "trajectory_id", "msg_idx", F.posexplode(F.get("arguments", F.lit(0))).alias("call_idx", "arguments")
    )


@query
def m2_native_arguments(spark, sf_dir):
    """The same without Python workers."""
    raw = F.transform(called_functions(F.col("tool_calls")), lambda function: function["arguments"])
    calls = _nested_messages(spark, sf_dir).select("trajectory_id", "msg_idx", native_arguments(raw).alias("arguments"))
    return calls.select("trajectory_id", "msg_idx", F.posexplode("arguments").alias("call_idx", "arguments"))


@query
def m3_wrap_tool_responses(spark, sf_dir):
    wrapped = render.wrap_tool_responses(_nested_messages(spark, sf_dir))
    return wrapped.filter(F.col("role") == "tool").select("trajectory_id", "msg_idx", "content")


@query
def m4_remap_tool_role(spark, sf_dir):
    rows = _nested_messages(spark, sf_dir)
    kept = render.remap_tool_role(rows, True).select("trajectory_id", "msg_idx", F.col("role").alias("kept"))
    mapped = render.remap_tool_role(rows).select("trajectory_id", "msg_idx", F.col("role").alias("mapped"))
    return kept.join(mapped, ["trajectory_id", "msg_idx"])


@query
def m5_render_text(spark, sf_dir):
    rows = render.render_trajectories(filters.with_messages(fx.trajectories(spark, sf_dir)))
    return rows.select("trajectory_id", "text", "prompt_boundary_char")


@query
def m5_render_parts(spark, sf_dir):
    return render.locate_parts(fx.messages(spark, sf_dir)).select(
        "trajectory_id", "msg_idx", "role", "part", "char_start", "char_end", "n_chars"
    )


@query
def m6_render_trailing(spark, sf_dir):
    rows = render.render_trajectories(filters.with_messages(fx.trajectories(spark, sf_dir)), trailing=True)
    return (
        filters.min_chars(rows.withColumn("n_chars", F.length("text")))
        .select("trajectory_id", "n_chars", F.md5("text").alias("digest"))
    )


@query
def m7_render_template(spark, sf_dir):
    rows = render.normalise_messages(_nested_messages(spark, sf_dir))
    return render.locate_parts(rows, CHAT).select(
        "trajectory_id", "msg_idx", "part", "char_start", "char_end", "n_chars"
    )


@query
def m8_assistant_ranges(spark, sf_dir):
    return render.assistant_ranges(render.locate_parts(fx.messages(spark, sf_dir)))


@query
def m9_prompt_boundary(spark, sf_dir):
    return render.prompt_boundary(render.locate_parts(fx.messages(spark, sf_dir))).select(
        "trajectory_id", "prompt_boundary_char", "n_chars"
    )


@query
def rendered_gold(spark, sf_dir):
    """Gold trajectories as rendered: length, assistant share, prompt boundary."""
    parts = filters.min_chars(fx.gold_parts(spark, sf_dir))
    length = F.when(F.col("role") == "assistant", F.length("part")).otherwise(0)
    return parts.groupBy("trajectory_id").agg(
        F.max("n_chars").alias("n_chars"),
        F.count("*").alias("n_parts"),
        F.round(F.sum(length) / F.max("n_chars"), 6).alias("assistant_share"),
        F.coalesce(
            F.min(F.when(F.col("role") == "assistant", F.col("char_start"))), F.max("char_end")
        ).alias("prompt_boundary_char"),
    )


# ---- tokens and masks -------------------------------------------------------------------


@query
def t1_tokenize(spark, sf_dir):
    return fx.conversation_tokens(spark, sf_dir).select("trajectory_id", "pos", "token", "tok_start", "tok_end")


@query
def t1_tokenize_documents(spark, sf_dir):
    rows = tokens.explode_tokens(render.locate_parts(_nested_messages(spark, sf_dir)))
    return rows.groupBy("trajectory_id").agg(
        F.count("*").alias("n_tokens"), F.max("tok_end").alias("n_chars"), F.count_distinct("token").alias("n_distinct")
    )


@query
def t2_dictionary(spark, sf_dir):
    return _dictionary(spark, sf_dir)


@query
def t2_unknown_token(spark, sf_dir):
    """Ids from the gold conversations' dictionary for all conversations."""
    rows = fx.conversation_tokens(spark, sf_dir, offsets=False)
    samples = tokens.assemble_samples(tokens.encode(rows, _gold_dictionary(spark, sf_dir), unk_id=999_999))
    return samples.select(
        "trajectory_id",
        F.size("input_ids").alias("n_tokens"),
        F.size(F.filter("input_ids", lambda i: i == 999_999)).alias("n_unknown"),
        as_text(F.col("input_ids")).alias("input_ids"),
    )


@query
def t2_wide_lookup(spark, sf_dir):
    """Ids where a head of 256 bytes is broadcast and all other tokens are shuffled."""
    rows = fx.conversation_tokens(spark, sf_dir, offsets=False)
    table = _dictionary(spark, sf_dir).select("token", "token_id")
    found = lookup(rows, table, "token", "token_id", head_bytes=256)
    return found.select("trajectory_id", "pos", "token", "token_id")


@query
def t1_windowed_tokenizer(spark, sf_dir):
    """All documents through a user's tokenizer in windows of 1,024 characters; blocks of 512 tokens."""
    parts = render.locate_parts(render.normalise_messages(_nested_messages(spark, sf_dir)))
    # Without the positions of the default tokenizer, which nothing reads here.
    parts = materialise(parts.select("trajectory_id", "role", "part", "char_start", "n_chars"), "parts")
    rows = windows.windowed_tokens(parts, fx.word_encoder(), window=1024, overlap=128)
    size = F.size("input_ids")
    first, last = F.floor(F.col("first_pos") / 512), F.floor((F.col("first_pos") + size - 1) / 512)
    # A window brings one row to each block that it reaches into, not one for each token.
    dealt = rows.where(size > 0).select(
        "trajectory_id", "first_pos", "input_ids", "tok_starts", "loss_mask", F.explode(F.sequence(first, last)).alias("block")
    )
    low = F.greatest(F.col("block") * 512 - F.col("first_pos"), F.lit(0))
    high = F.least((F.col("block") + 1) * 512 - F.col("first_pos"), size)
    cut = [F.slice(name, (low + 1).cast("int"), (high - low).cast("int")).alias(name) for name in ("input_ids", "tok_starts", "loss_mask")]
    pieces = dealt.select("trajectory_id", "block", F.struct((F.col("first_pos") + low).alias("pos"), *cut).alias("t"))
    blocks = pieces.groupBy("trajectory_id", "block").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def joined(name):
        return F.flatten(F.transform("ts", lambda t: t[name]))

    return blocks.select(
        "trajectory_id",
        "block",
        as_text(joined("input_ids")).alias("input_ids"),
        F.array_join(joined("loss_mask").cast("array<string>"), "").alias("loss_mask"),
        F.array_min(joined("tok_starts")).alias("first_char"),
    )


@query
def t3_loss_mask(spark, sf_dir):
    return fx.conversation_tokens(spark, sf_dir, offsets=False).select("trajectory_id", "pos", "loss_mask")


@query
def t3_overlap_mask(spark, sf_dir):
    """Mask and boundary for a tokenizer whose tokens reach over the edges of parts."""
    rendered = render.render_trajectories(filters.with_messages(fx.trajectories(spark, sf_dir)))
    texts = rendered.select("trajectory_id", "text", "assistant_ranges", "prompt_boundary_char")
    rows = tokens.tokenize_with(texts, fx.word_encoder(), ranges="assistant_ranges")
    boundary = tokens.boundary_token(F.col("tok_starts"), F.col("prompt_boundary_char"))
    return rows.select(
        "trajectory_id",
        F.size("input_ids").alias("n_tokens"),
        F.array_join(F.col("loss_mask").cast("array<string>"), "").alias("loss_mask"),
        boundary.alias("prompt_boundary"),
    )


@query
def t4_prompt_boundary_token(spark, sf_dir):
    return render.prompt_boundary(render.locate_parts(fx.messages(spark, sf_dir))).select(
        "trajectory_id", "prompt_boundary", "n_tokens"
    )


@query
def t5_valid_mask(spark, sf_dir):
    teacher, _ = fx.count_scores(spark, sf_dir, K)
    return tokens.valid_mask(teacher).select("trajectory_id", "pos", "loss_mask", "is_valid")


@query
def t6_align_mask(spark, sf_dir):
    """A stored mask that is absent, longer, or shorter than 512 ids."""
    samples = _samples(spark, sf_dir).withColumn("ids", tokens.truncate(F.col("input_ids"), 512))
    length = F.size("ids")

    def aligned(mask):
        return F.array_join(tokens.align_mask(mask, length).cast("array<string>"), "")

    return samples.select(
        "trajectory_id",
        length.alias("n_tokens"),
        aligned(F.lit(None).cast("array<int>")).alias("absent"),
        aligned(F.col("loss_mask")).alias("longer"),
        aligned(F.slice("loss_mask", 1, 100)).alias("shorter"),
    )


@query
def t7_truncate(spark, sf_dir):
    teacher, _ = fx.count_scores(spark, sf_dir, K)
    return tokens.truncate_positions(teacher, 512).groupBy("trajectory_id").agg(
        F.count("*").alias("n_tokens"),
        F.count("top_ids").alias("n_scored"),
        F.sum((F.col("pos") + 1) * F.col("token_id").cast("bigint")).alias("id_sum"),
    )


@query
def t7_truncate_documents(spark, sf_dir):
    rows = tokens.explode_tokens(render.locate_parts(_nested_messages(spark, sf_dir)), offsets=False, max_tokens=512)
    return rows.groupBy("trajectory_id").agg(
        F.count("*").alias("n_tokens"), F.sum((F.col("pos") + 1) * F.length("token")).cast("bigint").alias("weighed")
    )


@query
def t8_attention_mask(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    return samples.select("trajectory_id", F.array_join(F.col("attention_mask").cast("array<string>"), "").alias("mask"))


def _windows(samples, boundary):
    ids, mask = tokens.prompt_window(F.col("input_ids"), F.col("attention_mask"), 64, boundary, pad_id=-1)
    return samples.select(
        "trajectory_id",
        as_text(ids).alias("prompt_ids"),
        F.array_join(mask.cast("array<string>"), "").alias("prompt_mask"),
    )


@query
def t9_prompt_window(spark, sf_dir):
    return _windows(_samples(spark, sf_dir), F.col("prompt_boundary"))


@query
def t10_prompt_first_n(spark, sf_dir):
    return _windows(_samples(spark, sf_dir), None)


# ---- scores and divergence --------------------------------------------------------------


@query
def k1_top_k(spark, sf_dir):
    teacher, _ = fx.dense_scores(spark, sf_dir)
    return divergence.dense_teacher_positions(teacher, K).select(
        "trajectory_id",
        "pos",
        as_text(F.col("top_ids")).alias("top_ids"),
        F.round(_total("top_vals"), 6).alias("val_sum"),
    )


@query
def k1_top_k_partial(spark, sf_dir):
    """Partial selection instead of a sort of every vector."""
    teacher, _ = fx.dense_scores(spark, sf_dir)
    return selection.with_top_k_partial(teacher, "logits", K).select(
        "trajectory_id",
        "pos",
        as_text(F.col("top_ids")).alias("top_ids"),
        F.round(_total("top_vals"), 6).alias("val_sum"),
    )


@query
def k1_top_k_rows(spark, sf_dir):
    teacher, _ = fx.dense_scores(spark, sf_dir)
    rows = teacher.select("trajectory_id", "pos", F.posexplode("logits").alias("token_id", "score"))
    return scores.top_k_rows(rows, K).select("trajectory_id", "pos", "rank", "token_id", F.round("score", 6).alias("score"))


@query
def k2_top_k_map(spark, sf_dir):
    """Maps of log-probabilities; the first position of a trajectory has none."""
    teacher, _ = fx.dense_scores(spark, sf_dir)
    soft = divergence.student_log_softmax(teacher)
    logp = F.zip_with("z", F.array_repeat(F.col("lse"), F.size("z")), lambda z, lse: z - lse)
    mapped = soft.withColumn("scores", F.when(F.col("pos") > 0, F.map_from_arrays("ids", logp)))
    best = scores.with_top_k(mapped, scores.top_k_map(F.col("scores"), K))
    return tokens.valid_mask(best).select(
        "trajectory_id",
        "pos",
        as_text(F.col("top_ids")).alias("top_ids"),
        F.round(_total("top_vals"), 4).alias("val_sum"),
        "is_valid",
        "loss_mask",
    )


@query
def k3_batch_scoring(spark, sf_dir):
    samples = build_samples(fx.gold_messages(spark, sf_dir), _gold_dictionary(spark, sf_dir))
    good, _ = scores.split_by_status(scores.score_with(samples, fx.echo_scorer()))
    return scores.cache_positions(good, 2).select(
        "trajectory_id",
        "seq_len",
        "prompt_boundary",
        "pos",
        "token_id",
        "loss_mask",
        as_text(F.col("top_ids")).alias("top_ids"),
        F.round(_total("top_vals"), 4).alias("val_sum"),
    )


@query
def k3_balanced_scoring(spark, sf_dir):
    """Tasks of equal tokens, micro-batches of 2,048 padded tokens, arrays out."""
    samples = build_samples(fx.messages(spark, sf_dir), _dictionary(spark, sf_dir))
    scored = scoring.score_arrays(samples, fx.echo_scorer(), max_tokens=2048, top_k=2, partitions=16)
    return scoring.cache_rows(scored).select(
        "trajectory_id",
        "seq_len",
        "prompt_boundary",
        "pos",
        "token_id",
        "loss_mask",
        as_text(F.col("top_ids")).alias("top_ids"),
        F.round(_total("top_vals"), 4).alias("val_sum"),
        "status",
    )


def _tag():
    return F.when(F.col("loss_mask") == 0, F.lit(None).cast("string")).when(F.col("pos") % 2 == 0, "logits").otherwise("other")


@query
def k5_score_format(spark, sf_dir):
    teacher, _ = fx.dense_scores(spark, sf_dir)
    return teacher.select("trajectory_id", "pos", scores.score_format(_tag()).alias("format"))


@query
def k6_teacher_distribution(spark, sf_dir):
    teacher, _ = fx.dense_scores(spark, sf_dir)
    top = divergence.dense_teacher_positions(teacher, K).withColumn("format", scores.score_format(_tag()))
    with_p = top.withColumn("u", teacher_exponents(F.col("top_vals"), F.col("format"), 2.0)).withColumn(
        "p", probabilities(F.col("u"))
    )
    return with_p.select(
        "trajectory_id",
        "pos",
        "format",
        F.round(F.element_at("p", 1), 6).alias("p_first"),
        F.round(F.element_at("p", -1), 6).alias("p_last"),
        F.round(_total("p"), 6).alias("p_sum"),
    )


@query
def k7_student_log_softmax(spark, sf_dir):
    _, student = fx.dense_scores(spark, sf_dir)
    warm = divergence.student_log_softmax(student, 2.0)
    return warm.select(
        "trajectory_id",
        "pos",
        F.round("lse", 6).alias("lse"),
        F.round(F.element_at("z", 1) - F.col("lse"), 6).alias("logp_first"),
        F.round(F.array_max("z") - F.col("lse"), 6).alias("logp_max"),
    )


@query
def k8_gather_student(spark, sf_dir):
    return _gathered(spark, sf_dir).select(
        "trajectory_id",
        "pos",
        F.size("student_logp").alias("n_scores"),
        "n_missing",
        F.round(_total("student_logp"), 6).alias("logp_sum"),
    )


@query
def k8_gather_wide(spark, sf_dir):
    """64 scores a position, listed by the student in another order."""
    teacher, student = fx.dense_scores(spark, sf_dir)
    top = divergence.dense_teacher_positions(teacher, 64)
    wide = divergence.gather_student(top, divergence.student_log_softmax(student, 2.0))
    return wide.select(
        "trajectory_id",
        "pos",
        "n_missing",
        F.round(_total("student_logp"), 5).alias("logp_sum"),
        F.round(F.element_at("student_logp", 1), 6).alias("logp_best"),
    )


@query
def k9_position_kl(spark, sf_dir):
    return _dense_kl(spark, sf_dir).select("trajectory_id", "pos", F.round("kl", 6).alias("kl"))


@query
def k10_masked_mean(spark, sf_dir):
    return divergence.masked_mean(_dense_kl(spark, sf_dir)).select(F.round("loss", 6).alias("loss"), "n_masked")


@query
def k11_chunked_mean(spark, sf_dir):
    rolled = divergence.roll_up_chunks(divergence.chunk_sums(_kl(spark, sf_dir)))
    return divergence.sample_loss(rolled).select("trajectory_id", "n_chunks", "n_masked", F.round("loss", 6).alias("loss"))


@query
def k12_dense_teacher_loss(spark, sf_dir):
    teacher, student = fx.dense_scores(spark, sf_dir)
    return divergence.dense_loss(teacher, student, K, 2.0).select(
        "trajectory_id", "n_masked", F.round("loss", 6).alias("loss")
    )


@query
def k12_partial_selection(spark, sf_dir):
    teacher, student = fx.dense_scores(spark, sf_dir)
    return divergence.dense_loss(teacher, student, K, 2.0, partial=True).select(
        "trajectory_id", "n_masked", F.round("loss", 6).alias("loss")
    )


@query
def k13_sample_kl(spark, sf_dir):
    return divergence.sample_loss(divergence.sample_sums(_kl(spark, sf_dir))).select(
        "trajectory_id", "n_masked", F.round("loss", 6).alias("loss")
    )


def _batched_sums(spark, sf_dir):
    order = batching.shuffled_index(_ids(spark, sf_dir), 0)
    placed = batching.assign_batches(order, 8).select("trajectory_id", "batch_id")
    return divergence.sample_sums(_kl(spark, sf_dir)).join(placed, "trajectory_id")


@query
def k14_batch_kl(spark, sf_dir):
    return divergence.batch_loss(_batched_sums(spark, sf_dir)).select(
        "batch_id", "n_masked", F.round("loss", 6).alias("loss")
    )


@query
def k14_exact_sum(spark, sf_dir):
    """Sums that do not depend on the order of rows."""
    order = batching.shuffled_index(_ids(spark, sf_dir), 0)
    placed = batching.assign_batches(order, 8).select("trajectory_id", "batch_id")
    sums = divergence.exact_sums(_kl(spark, sf_dir)).join(placed, "trajectory_id")
    return divergence.exact_batch_loss(sums).select("batch_id", "n_masked", F.round("loss", 6).alias("loss"))


@query
def k14_clustered(spark, sf_dir):
    """Batch losses from a compacted store."""
    store = ScoreStore(spark, fresh_path(spark, "store"))
    rows, student = _store_rows(spark, sf_dir)
    store.append(rows)
    version = store.compact()
    gathered = divergence.gather_student_chunks(store.chunks(version), student, buckets=version.buckets)
    order = batching.shuffled_index(_ids(spark, sf_dir), 0)
    placed = batching.assign_batches(order, 8).select("trajectory_id", "batch_id")
    sums = divergence.sample_sums(divergence.position_kl(gathered)).join(placed, "trajectory_id")
    return divergence.batch_loss(sums).select("batch_id", "n_masked", F.round("loss", 6).alias("loss"))


@query
def k15_mean_of_samples(spark, sf_dir):
    return divergence.batch_mean_of_samples(_batched_sums(spark, sf_dir), accumulation_steps=4).select(
        "batch_id", "n_samples", F.round("loss", 6).alias("loss")
    )


@query
def k16_mask_choice(spark, sf_dir):
    """Positions with an odd id have no loss mask here and fall back to the attention mask."""
    kl = _dense_kl(spark, sf_dir)
    absent = F.when(F.element_at("top_ids", 1) % 2 == 0, F.col("loss_mask"))
    chosen = kl.withColumn("loss_mask", divergence.chosen_mask(absent, F.lit(1)))
    return divergence.masked_mean(chosen, ["trajectory_id"]).select(
        "trajectory_id", "n_masked", F.round("loss", 6).alias("loss")
    )


@query
def k17_evaluation_mean(spark, sf_dir):
    losses = divergence.batch_loss(_batched_sums(spark, sf_dir))
    return divergence.mean_of_batches(losses).select(F.round("avg_loss", 6).alias("avg_loss"), "n_batches")


# ---- split, batches, padding ------------------------------------------------------------


@query
def b1_split(spark, sf_dir):
    return batching.split_train_val(fx.headers(spark, sf_dir).select("trajectory_id"))


@query
def b1_split_overlap(spark, sf_dir):
    """Repositories on both sides of a split by trajectory."""
    rows = filters.gold(fx.trajectories(spark, sf_dir)).select("trajectory_id", "repo")
    return batching.split_overlap(batching.split_train_val(rows), "repo")


@query
def b2_sample_index(spark, sf_dir):
    return batching.sample_index(fx.headers(spark, sf_dir).select("trajectory_id"))


@query
def b3_shuffle(spark, sf_dir):
    ids = fx.headers(spark, sf_dir).select("trajectory_id")
    epochs = [batching.shuffled_index(ids, epoch).withColumn("epoch", F.lit(epoch)) for epoch in (0, 1)]
    return epochs[0].unionByName(epochs[1])


@query
def b4_assign_batches(spark, sf_dir):
    ids = fx.headers(spark, sf_dir).select("trajectory_id")
    return batching.assign_batches(batching.shuffled_index(ids, 0), 8)


@query
def b5_pad_batch(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    order = batching.assign_batches(batching.shuffled_index(_ids(spark, sf_dir), 0), 8)
    padded = batching.pad_batch(
        samples.join(order.drop("idx"), "trajectory_id"), pad_id=-1, max_length=1024
    )

    def digits(name):
        return F.array_join(F.col(name).cast("array<string>"), "").alias(name)

    return padded.select(
        "trajectory_id",
        "batch_id",
        "slot",
        "batch_max_len",
        as_text(F.col("input_ids")).alias("input_ids"),
        digits("attention_mask"),
        digits("loss_mask"),
    )


@query
def b5_chunked_batches(spark, sf_dir):
    """Batches in rows of one chunk of a compacted store, padding counted."""
    store = ScoreStore(spark, fresh_path(spark, "store"))
    store.append(_store_rows(spark, sf_dir)[0])
    version = store.compact()
    assignment = assign_epoch(_ids(spark, sf_dir), 0, 8)
    rows = batches.chunked_batches(
        store.chunks(version), store.headers(version), assignment, K, max_tokens=2500, max_prompt=64, pad_id=-1
    )
    return rows.select(
        "trajectory_id",
        "split",
        "batch_id",
        "slot",
        "chunk",
        "batch_max_len",
        "n_tokens",
        "n_padding",
        as_text(F.col("input_ids")).alias("input_ids"),
        F.array_join(F.col("loss_mask").cast("array<string>"), "").alias("loss_mask"),
        as_text(F.col("prompt_ids")).alias("prompt_ids"),
        F.size(F.flatten("teacher_indices")).alias("n_scores"),
        F.round(_total(F.flatten("teacher_values")), 3).alias("val_sum"),
    )


def _score_samples(spark, sf_dir):
    """Dense top-2 scores gathered per trajectory of 50 positions, cut to 30 + the mask sum."""
    teacher, _ = fx.dense_scores(spark, sf_dir)
    top = divergence.dense_teacher_positions(teacher, 2)
    rows = F.array_sort(F.collect_list(F.struct("pos", "top_ids", "top_vals", "loss_mask")))
    n_scored = F.least(F.lit(50), F.aggregate("loss_mask", F.lit(20), lambda a, x: a + x))
    return (
        top.groupBy("trajectory_id")
        .agg(rows.alias("r"))
        .select(
            "trajectory_id",
            F.col("r.loss_mask").alias("loss_mask"),
            F.col("r.top_vals").alias("v"),
            F.col("r.top_ids").alias("i"),
        )
        .withColumn("n_scored", n_scored)
        .select(
            "trajectory_id",
            "loss_mask",
            "n_scored",
            F.slice("v", F.lit(1), F.col("n_scored")).alias("teacher_values"),
            F.slice("i", F.lit(1), F.col("n_scored")).alias("teacher_indices"),
        )
    )


@query
def b6_pad_scores(spark, sf_dir):
    padded = batching.pad_scores(_score_samples(spark, sf_dir).withColumn("batch_max_len", F.lit(50)), 2)
    return padded.select(
        "trajectory_id",
        "n_scored",
        F.size("teacher_values").alias("n_rows"),
        F.round(_total(F.flatten("teacher_values")), 4).alias("val_sum"),
        as_text(F.flatten("teacher_indices")).alias("indices"),
    )


@query
def b6_batch_length(spark, sf_dir):
    """Scores of batches of three, brought to the length that the batch's ids have."""
    samples = _score_samples(spark, sf_dir).withColumn("input_ids", F.transform("teacher_indices", lambda ids: ids[0]))
    order = batching.assign_batches(batching.shuffled_index(samples.select("trajectory_id"), 0), 3)
    padded = batching.pad_scores(batching.pad_batch(samples.join(order, "trajectory_id").drop("loss_mask")), 2)
    return padded.select(
        "trajectory_id",
        "batch_id",
        "batch_max_len",
        F.size("input_ids").alias("n_ids"),
        F.size("teacher_values").alias("n_rows"),
        F.round(_total(F.flatten("teacher_values")), 4).alias("val_sum"),
        as_text(F.flatten("teacher_indices")).alias("indices"),
    )


@query
def b7_batch_metadata(spark, sf_dir):
    """Batches of three; a trajectory with few scored positions counts as a raw-logits cache, and
    some of the others carry no format.
    """
    samples = _score_samples(spark, sf_dir).withColumn(
        "format", F.when(F.col("n_scored") < 44, "logits").when(F.col("n_scored") % 2 == 0, "logprobs")
    )
    order = batching.assign_batches(batching.shuffled_index(samples.select("trajectory_id"), 0), 3)
    return batching.batch_metadata(samples.join(order, "trajectory_id"))


# ---- profiles and metrics ---------------------------------------------------------------


@query
def a1_message_profile(spark, sf_dir):
    return profile.message_profile(filters.gold(fx.headers(spark, sf_dir))).withColumn(
        "avg_messages", F.round("avg_messages", 6)
    )


@query
def a2_funnel(spark, sf_dir):
    lengths = render.prompt_boundary(render.locate_parts(fx.messages(spark, sf_dir)))
    rows = fx.headers(spark, sf_dir).join(lengths.select("trajectory_id", "n_tokens"), "trajectory_id", "left")
    return profile.funnel(rows, F.col("n_tokens") >= 1000)


@query
def a3_running_loss(spark, sf_dir):
    return profile.running_loss(fx.training_steps(spark, sf_dir), 5).withColumn(
        "avg_loss", F.round("avg_loss", 6)
    )


@query
def a3_accumulated_loss(spark, sf_dir):
    return profile.running_loss(fx.training_steps(spark, sf_dir), 3, accumulation_steps=2).withColumn(
        "avg_loss", F.round("avg_loss", 6)
    )


@query
def a4_new_best(spark, sf_dir):
    return profile.new_best(fx.epoch_losses(spark, sf_dir))


@query
def a4_exact_best(spark, sf_dir):
    """Epochs with new best losses, from sums that do not depend on the order of the steps."""
    losses = profile.exact_losses(fx.training_steps(spark, sf_dir))
    return profile.new_best(losses).withColumn("val_loss", F.round("val_loss", 6))


@query
def a5_every_nth_epoch(spark, sf_dir):
    return profile.every_nth_epoch(fx.epoch_losses(spark, sf_dir), 2)


# ---- whole jobs -------------------------------------------------------------------------


@query
def prepare_gold_set(spark, sf_dir):
    """Filter, write and profile the gold set."""
    return prepare_gold(fx.trajectories(spark, sf_dir), fresh_path(spark, "gold")).withColumn(
        "avg_messages", F.round("avg_messages", 6)
    )


def _cache_sums(spark, path):
    return score_cache.read_cache(spark, path).groupBy("trajectory_id").agg(
        F.count("*").alias("n_tokens"),
        F.sum("loss_mask").alias("n_masked"),
        F.sum("is_valid").alias("n_valid"),
        F.sum(F.element_at("top_ids", 1).cast("bigint")).alias("best_id_sum"),
        F.round(F.sum(_total("top_vals")), 4).alias("val_sum"),
    )


@query
def build_score_cache(spark, sf_dir):
    """Skip, render, tokenize, score, mask, write; then read the cache back."""
    path = fresh_path(spark, "cache")
    failed = build_cache(
        fx.gold_messages(spark, sf_dir), _gold_dictionary(spark, sf_dir), path, fx.echo_scorer(), top_k=2
    )
    if not failed.isEmpty():
        raise RuntimeError("the scorer refused a trajectory")
    return _cache_sums(spark, path)


@query
def build_cache_user_tokenizer(spark, sf_dir):
    """The same over all conversations with a tokenizer of the user's."""
    path = fresh_path(spark, "cache")
    build_cache(
        fx.messages(spark, sf_dir), None, path, fx.echo_scorer(), top_k=2, make_encoder=fx.word_encoder()
    )
    return _cache_sums(spark, path).join(
        score_cache.read_headers(spark, path).select("trajectory_id", "prompt_boundary"), "trajectory_id"
    )


@query
def training_batches(spark, sf_dir):
    """The stored cache as padded batches with prompt windows and teacher scores."""
    path = _counted_cache(spark, sf_dir)
    padded = batches.training_batches(
        score_cache.read_cache(spark, path),
        score_cache.read_headers(spark, path),
        assign_epoch(_ids(spark, sf_dir), 0, 8),
        K,
        max_tokens=512,
        max_prompt=64,
        pad_id=-1,
    )
    return padded.select(
        "trajectory_id",
        "split",
        "batch_id",
        "slot",
        "batch_max_len",
        "n_tokens",
        as_text(F.col("input_ids")).alias("input_ids"),
        F.array_join(F.col("loss_mask").cast("array<string>"), "").alias("loss_mask"),
        as_text(F.col("prompt_ids")).alias("prompt_ids"),
        F.size("teacher_values").alias("n_rows"),
        F.size(F.flatten("teacher_indices")).alias("n_scores"),
        F.round(_total(F.flatten("teacher_values")), 3).alias("val_sum"),
    )


@query
def evaluate_epoch(spark, sf_dir):
    """Split, order, batch, join the student's scores, and average the batch losses, for two epochs."""
    teacher, student = fx.count_scores(spark, sf_dir, K, by_position=True)
    # The student is the same in both epochs: scored once.
    sums = materialise(trajectory_sums(teacher, student), "sums")

    def losses(epoch):
        return mean_losses(sums, assign_epoch(_ids(spark, sf_dir), epoch, 8)).withColumn("epoch", F.lit(epoch))

    return losses(0).unionByName(losses(1)).withColumn("avg_loss", F.round("avg_loss", 6))


@query
def evaluate_clustered(spark, sf_dir):
    """``evaluate_epoch`` from a compacted store: scored once, evaluated for two epochs."""
    store = ScoreStore(spark, fresh_path(spark, "store"))
    rows, student = _store_rows(spark, sf_dir)
    store.append(rows)
    store.compact()
    student = materialise(student, "student")

    def losses(epoch):
        return evaluate_store(store, student, assign_epoch(_ids(spark, sf_dir), epoch, 8)).withColumn("epoch", F.lit(epoch))

    return losses(0).unionByName(losses(1)).withColumn("avg_loss", F.round("avg_loss", 6))
