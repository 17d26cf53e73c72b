"""The given tables seen as trajectories, tool messages, scores and training steps.

Stand-ins for recorded trajectories and model scores; used by the registered queries, the tests
and the benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.operators.filters import gold
from tracemill.operators.lookup import lookup
from tracemill.operators.ordering import grouped_index
from tracemill.operators.render import locate_parts
from tracemill.operators.tokens import explode_tokens, token_dictionary
from tracemill.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One whose rows lie in fewer partitions than there are cores is spread out first.

    Partitions with rows are counted, as a file of one row group is cut into many splits of which
    only one has rows. Only the files' footers are read for it.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores, splits = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    filled = 0 if splits < cores else df.select(F.spark_partition_id().alias("split")).distinct().count()
    return df.repartition(max(cores, splits)) if filled < cores else df


# ---- conversations: one row per message -------------------------------------------------


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trajectory_id, resolved, exit_status) of every labelled id."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("trajectory_id"),
        F.col("quality").alias("resolved"),
        F.when(F.col("toxic") == 0, "submit").when(F.col("toxic") == 1, "error").alias("exit_status"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as message rows (trajectory_id, msg_idx, role, content)."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("trajectory_id"),
        F.col("turn").cast("int").alias("msg_idx"),
        "role",
        F.col("text").alias("content"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation: number of messages and flags (NULL if unlabelled)."""
    counted = messages(spark, sf_dir).groupBy("trajectory_id").agg(F.count("*").alias("n_messages"))
    return counted.join(flags(spark, sf_dir), "trajectory_id", "left")


def gold_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    solved = gold(flags(spark, sf_dir)).select("trajectory_id")
    return messages(spark, sf_dir).join(solved, "trajectory_id", "left_semi")


def gold_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate_parts(gold_messages(spark, sf_dir))


def conversation_tokens(spark: SparkSession, sf_dir: str, offsets: bool = True) -> DataFrame:
    return explode_tokens(locate_parts(messages(spark, sf_dir)), offsets=offsets)


def gold_tokens(spark: SparkSession, sf_dir: str, offsets: bool = True) -> DataFrame:
    return explode_tokens(gold_parts(spark, sf_dir), offsets=offsets)


# ---- documents: one nested row per trajectory -------------------------------------------


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nested trajectories, one message per line.

    Line 0 is the system message; lines 1, 2, 3, 4 ... take turns as user, assistant, tool. Even
    assistant lines call a tool, every other one of them without text, and lines that are a
    multiple of 10 with arguments that are not JSON; odd tool lines carry a name. Flags come from
    the labels and are NULL for documents without one.
    """
    lines = F.split("text", "\n")

    def message(line, i):
        role = (
            F.when(i == 0, "system").when(i % 3 == 1, "user").when(i % 3 == 2, "assistant").otherwise("tool")
        )
        arguments = F.when(i % 10 == 0, F.lit('ls "src"')).otherwise(
            F.concat(F.lit('{"line":'), i.cast("string"), F.lit(',"deep":  [1, 2.50]}'))
        )
        function = F.struct(F.when(i % 4 == 0, "edit").alias("name"), arguments.alias("arguments"))
        calls = F.array(
            F.struct(F.when(i > 2, function).alias("function")),
            F.struct(F.struct(F.lit("view").alias("name"), F.lit(None).cast("string").alias("arguments")).alias("function")),
        )
        calling = (i % 3 == 2) & (i % 2 == 0)
        # One more call with an empty function, which counts as none.
        empty = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"))
        calls = F.concat(calls, F.array(F.struct(empty.alias("function"))))
        return F.struct(
            role.alias("role"),
            F.when(calling & (i % 4 == 0), None).otherwise(line).alias("content"),
            F.when((i % 3 == 0) & (i % 2 == 1), "shell").alias("name"),
            F.when(calling, calls).alias("tool_calls"),
        )

    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("trajectory_id"),
        F.concat_ws("-", "lang", F.col("doc_id").cast("string")).alias("instance_id"),
        F.col("source").alias("repo"),
        F.transform(lines, message).alias("trajectory"),
    )
    return rows.join(flags(spark, sf_dir), "trajectory_id", "left").select(
        "trajectory_id",
        "instance_id",
        "repo",
        "trajectory",
        "resolved",
        "exit_status",
        F.lit(None).cast("string").alias("model_patch"),
    )


# ---- embeddings: dense logits -----------------------------------------------------------


def dense_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Teacher and student logits, 50 positions per trajectory; the student is one vector ahead."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.agg(F.max("vec_id")).first()[0] + 1

    def place(vec_id):
        return [
            F.floor(vec_id / 50).cast("string").alias("trajectory_id"),
            (vec_id % 50).cast("int").alias("pos"),
        ]

    teacher = vectors.select(
        *place(F.col("vec_id")),
        F.col("embedding").cast("array<double>").alias("logits"),
        (F.col("label") % 2).alias("loss_mask"),
    )
    student = vectors.select(
        *place((F.col("vec_id") + F.lit(n - 1)) % F.lit(n)),
        F.col("embedding").cast("array<double>").alias("logits"),
    )
    return teacher, student


# ---- conversations: count-based scores --------------------------------------------------


def count_scores(
    spark: SparkSession, sf_dir: str, k: int = 8, *, by_position: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Teacher cache rows and student rows from token counts of all conversations.

    Teacher: the ``k`` likeliest successors of the token before, by relative frequency. Student:
    add-one smoothed frequency of each token, already normalised (lse = 0). Position 0 has no
    scores. ``by_position`` is for rows that will be joined by position: they are shuffled by it
    before their scores are looked up.
    """
    by = ["trajectory_id", "pos"] if by_position else []
    parts = materialise(locate_parts(messages(spark, sf_dir), previous=True), "parts")
    tokens = explode_tokens(parts, offsets=False)
    dictionary = token_dictionary(tokens)
    n_tokens, n_distinct = dictionary.agg(F.sum("n"), F.count("*")).first()

    pairs = tokens.filter(F.col("pos") > 0).groupBy("prev_token", "token").agg(F.count("*").alias("n_pair"))
    context = Window.partitionBy("prev_token")
    likeliest = context.orderBy(F.desc("n_pair"), F.asc("token"))
    ranked = pairs.withColumn("n_context", F.sum("n_pair").over(context)).withColumn("rank", F.row_number().over(likeliest))
    # Written: it is small, and each look-up would count the pairs again.
    best = materialise(ranked.filter(F.col("rank") <= k), "best")
    best = lookup(best, dictionary, "token", "token_id")
    best = best.select(
        "prev_token",
        "rank",
        "token_id",
        F.ln(F.col("n_pair") / F.col("n_context")).alias("val"),
        F.ln((F.col("n") + 1) / F.lit(n_tokens + n_distinct)).alias("z"),
    )
    # At most k rows per context.
    ranked = best.groupBy("prev_token").agg(F.array_sort(F.collect_list(F.struct("rank", "token_id", "val", "z"))).alias("s"))
    by_context = lookup(ranked, dictionary.withColumnRenamed("token", "prev_token"), "prev_token", "token_id").select(
        "prev_token",
        F.col("token_id").alias("prev_rank"),
        F.col("s.token_id").alias("ids"),
        F.col("s.val").alias("vals"),
        F.col("s.z").alias("z"),
    )
    by_context = materialise(by_context, "contexts")
    ids = dictionary.select("token", "token_id")
    encoded = lookup(tokens, ids, "token", "token_id")
    teacher = lookup(encoded, by_context.select("prev_token", "prev_rank", "ids", "vals"), "prev_token", "prev_rank", by=by).select(
        "trajectory_id",
        F.floor(F.col("pos") / 1024).cast("int").alias("chunk"),
        "pos",
        "token_id",
        "loss_mask",
        F.col("ids").alias("top_ids"),
        F.col("vals").alias("top_vals"),
        F.lit("logprobs").alias("format"),
    )
    student = lookup(
        tokens.select("trajectory_id", "pos", "prev_token"),
        by_context.select("prev_token", "prev_rank", "ids", "z"),
        "prev_token",
        "prev_rank",
        by=by,
    ).select("trajectory_id", "pos", F.lit(0.0).alias("lse"), "ids", "z")
    return teacher, student.filter(F.col("pos") > 0)


# ---- embeddings: archives ---------------------------------------------------------------


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``.npz`` archive per 50 vectors, the entries in steps of 1/64 (exact in half precision)."""
    import io

    import numpy as np

    rows = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 50).cast("string").alias("trajectory_id"),
        (F.col("vec_id") % 50).cast("int").alias("pos"),
        "embedding",
        "label",
    )

    def pack(group):
        group = group.sort_values("pos")
        vectors = np.stack(group["embedding"].to_numpy())
        buffer = io.BytesIO()
        np.savez_compressed(
            buffer,
            values=(np.floor(vectors.astype(np.float64) * 64) / 64).astype(np.float16),
            indices=np.tile(np.arange(vectors.shape[1], dtype=np.int32), (len(vectors), 1)),
            input_ids=group["label"].to_numpy(dtype=np.int32)[None, :],
            format=np.array(["logits"]),
            loss_mask=(group["label"].to_numpy() % 2).astype(np.int32),
            prompt_boundary=np.array([len(vectors) // 2], dtype=np.int32),
        )
        return group.iloc[:1][["trajectory_id"]].assign(content=buffer.getvalue())

    # Groups of 50 rows by construction.
    return rows.groupBy("trajectory_id").applyInPandas(pack, "trajectory_id string, content binary")


# ---- events: training steps -------------------------------------------------------------


def training_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps: one run per user, 10 steps per epoch, value as loss."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", F.col("value").alias("loss")
    )
    numbered = grouped_index(events, "run_id", ["ts", "event_id"], "_step")
    return numbered.select(
        "run_id", F.floor(F.col("_step") / 10).alias("epoch"), (F.col("_step") % 10).alias("step"), "loss"
    )


def epoch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_steps(spark, sf_dir).groupBy("run_id", "epoch").agg(F.round(F.avg("loss"), 6).alias("val_loss"))


# ---- scorer for the plug point ----------------------------------------------------------


def echo_scorer(longest: int | None = None):
    """A scorer whose scores are plain functions of token id and position; refuses long sequences."""

    def make():
        def score_one(ids):
            if longest is not None and len(ids) > longest:
                raise ValueError(f"{len(ids)} tokens")
            return [
                {token: -0.5 - pos % 3, token + 1: -1.0, token + 2: -0.25 * (token % 8)} if pos else None
                for pos, token in enumerate(ids)
            ]

        return lambda batch: [score_one(ids) for ids in batch]

    return make


def careless_scorer():
    """A scorer that leaves out answers, or single scores, by the length of the sequence."""

    def make():
        def score_all(batch):
            out = []
            for ids in batch:
                found = [{token: -1.0} for token in ids]
                kind = len(ids) % 5
                if kind == 0:
                    out.append(None)
                elif kind == 1:
                    out.append(found[:-1])
                elif kind == 2:
                    out.append([*found, {0: -1.0}])
                elif kind == 4:
                    out.append(found)
            return out

        return score_all

    return make


def word_encoder():
    """A tokenizer whose tokens reach over the edges of parts: runs of white space, runs of the rest."""

    def make():
        import re

        pattern = re.compile(r"[^ \t\n]+|[ \t\n]+")

        def encode_all(texts):
            found = [list(pattern.finditer(text)) for text in texts]
            return [([len(m.group()) for m in ms], [m.span() for m in ms]) for ms in found]

        return encode_all

    return make
