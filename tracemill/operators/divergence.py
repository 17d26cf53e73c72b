"""Sparse KL divergence between cached teacher scores and student scores, and its means.

Teacher rows: (trajectory_id, pos, loss_mask, format, top_ids, top_vals). Student rows:
(trajectory_id, pos, lse, ids, z), where z holds logits divided by T at the listed ids and lse
the log-sum-exp of all logits divided by T, because ln q = z/T - lse. Dense student rows hold
all logits in ``logits`` instead. The k scores of a position stay in arrays throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed
from tracemill.functions.distributions import log_sum_exp, scaled, sparse_kl, teacher_exponents
from tracemill.operators.scores import score_format, top_k_dense, with_top_k
from tracemill.operators.selection import with_top_k_partial


def student_log_softmax(student: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Dense logits to (ids, z, lse) with every vocabulary entry listed."""
    return (
        student.withColumn("z", scaled(F.col("logits"), temperature))
        .withColumn("lse", log_sum_exp(F.col("z")))
        .withColumn("ids", F.sequence(F.lit(0), F.size("z") - 1))
        .drop("logits")
    )


def _gather(teacher: DataFrame, scores: DataFrame, z: Column) -> DataFrame:
    """Join student rows (_z, _lse) by position; ``z`` has their scores at the teacher's ids."""
    return _at_ids(teacher.join(scores, ["trajectory_id", "pos"], "left"), z)


def _at_ids(joined: DataFrame, z: Column) -> DataFrame:
    logp = F.zip_with(z, F.array_repeat(F.col("_lse"), F.size("top_ids")), lambda z, lse: z - lse)
    missing = F.size(F.filter("student_logp", lambda x: x.isNull()))
    return (
        joined.withColumn("student_logp", logp)
        .withColumn("n_missing", F.coalesce(missing, F.lit(0)))
        .drop("_z", "_lse")
    )


def gather_student(teacher: DataFrame, student: DataFrame, *, shift: int = 0) -> DataFrame:
    """Add ``student_logp``, the student's ln q at each teacher id, and ``n_missing``.

    ``shift=1`` pairs teacher position p with student position p - 1. An id the student does not
    list gives NULL and is counted, as is every id of a position without a student row. Ids
    listed twice for one position are an error. Where both sides list the same ids in the same
    order, as students scored at the teacher's ids do, scores are taken by position.
    """
    # Left as it is without a shift: rows that are partitioned by position stay so.
    pos = F.col("pos") + shift if shift else F.col("pos")
    scores = student.select(
        "trajectory_id",
        pos.cast("int").alias("pos"),
        F.col("ids").cast("array<int>").alias("_ids"),
        F.col("z").alias("_z"),
        F.col("lse").alias("_lse"),
    )
    return _gather(teacher, scores, _listed()).drop("_ids")


def _listed() -> Column:
    """Student scores (_ids, _z) at the teacher's ids; an id listed twice is an error."""

    def place(i: Column) -> Column:
        at = F.array_position(F.col("_ids"), i)
        return F.when(at > 0, F.get(F.col("_z"), (at - 1).cast("int")))

    twice = F.size(F.array_distinct("_ids")) < F.size("_ids")
    problem = F.raise_error(F.lit("a student id is listed twice")).cast("array<double>")
    # A teacher lists no id twice, so neither does a student that lists the same.
    aligned = F.col("_ids") == F.col("top_ids")
    return F.when(aligned, F.col("_z")).when(twice, problem).otherwise(F.transform("top_ids", place))


def gather_student_chunks(chunks: DataFrame, student: DataFrame, *, shift: int = 0, buckets: int | None = None) -> DataFrame:
    """``gather_student`` for a cache stored as chunk rows (trajectory_id, chunk, format, rows).

    Student rows are shuffled into chunks, ``buckets`` of them if the cache is bucketed so; the
    cache is read where it lies. Result: positions, as from ``gather_student``.
    """
    keys = ["trajectory_id", "chunk"]
    scores = student.select(
        "trajectory_id",
        F.floor((F.col("pos") + shift) / fixed.CHUNK_POSITIONS).cast("int").alias("chunk"),
        F.struct(
            (F.col("pos") + shift).cast("int").alias("pos"),
            F.col("ids").cast("array<int>").alias("_ids"),
            F.col("z").alias("_z"),
            F.col("lse").alias("_lse"),
        ).alias("s"),
    )
    scores = scores.repartition(buckets, *keys) if buckets else scores
    # No more rows than a chunk has positions.
    lists = scores.groupBy(*keys).agg(F.sort_array(F.collect_list("s")).alias("_s"))
    first, last = F.get("_s", F.lit(0))["pos"], F.element_at("_s", -1)["pos"]
    # Gaps are filled, so that a position is found by its distance from the first.
    dense = F.when(last - first + 1 == F.size("_s"), F.col("_s")).otherwise(
        F.transform(F.sequence(first, last), lambda p: F.get(F.filter("_s", lambda s: s["pos"] == p), F.lit(0)))
    )
    lists = lists.select(*keys, first.alias("_first"), dense.alias("_s"))
    joined = chunks.join(lists.hint("merge"), keys, "left").select(
        *keys,
        "format",
        F.explode(
            F.zip_with(
                "rows",
                F.transform("rows", lambda r: F.get(F.col("_s"), r["pos"] - F.col("_first"))),
                lambda r, s: F.struct(r.alias("r"), s.alias("s")),
            )
        ).alias("e"),
    )
    rows = joined.select(*keys, "format", "e.r.*", "e.s._ids", "e.s._z", "e.s._lse")
    return _at_ids(rows, _listed()).drop("_ids")


def gather_dense(teacher: DataFrame, student: DataFrame, temperature: float = 1.0) -> DataFrame:
    """The same for dense student logits, read by array index."""
    scores = student.select(
        "trajectory_id", "pos", scaled(F.col("logits"), temperature).alias("_z")
    ).withColumn("_lse", log_sum_exp(F.col("_z")))
    return _gather(teacher, scores, F.transform("top_ids", lambda i: F.get(F.col("_z"), i)))


def position_kl(gathered: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Add ``kl`` per position: KL(teacher || student) over the teacher's ids.

    NULL where there are no teacher scores. Raises if a masked position misses a student score.
    """
    exponents = teacher_exponents(F.col("top_vals"), score_format(F.col("format")), temperature)
    kl = gathered.withColumn("_u", exponents).withColumn("kl", sparse_kl(F.col("_u"), F.col("student_logp")))
    broken = (F.col("loss_mask") > 0) & (F.col("n_missing") > 0)
    return kl.withColumn(
        "kl",
        F.when(
            broken,
            F.raise_error(
                F.concat(F.lit("no student score for trajectory "), "trajectory_id", F.lit(" position "), "pos")
            ).cast("double"),
        ).otherwise(F.col("kl")),
    ).drop("_u")


def _sums() -> list[Column]:
    # A position without scores counts as masked out.
    weight = F.when(F.col("kl").isNotNull(), F.col("loss_mask")).otherwise(0)
    return [
        F.sum(F.coalesce(F.col("kl"), F.lit(0.0)) * weight).alias("kl_sum"),
        F.sum(weight).alias("n_masked"),
    ]


def _mean(total: Column, count: Column) -> Column:
    return (total / (count + F.lit(fixed.MEAN_EPSILON))).alias("loss")


def masked_mean(positions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of kl over masked positions divided by their number + 1e-8, per key."""
    return positions.groupBy(*keys).agg(*_sums()).select(*keys, _mean(F.col("kl_sum"), F.col("n_masked")), "n_masked")


def chunk_sums(positions: DataFrame, chunk: int = fixed.CHUNK_POSITIONS) -> DataFrame:
    """kl_sum and n_masked per trajectory and slice of ``chunk`` positions."""
    slice_number = F.floor(F.col("pos") / chunk).cast("int").alias("chunk")
    return positions.groupBy("trajectory_id", slice_number).agg(*_sums())


def sample_sums(positions: DataFrame) -> DataFrame:
    """kl_sum and n_masked per trajectory; batches are formed from these, not from positions."""
    return positions.groupBy("trajectory_id").agg(*_sums())


def exact_sums(positions: DataFrame, keys: Sequence[str] = ("trajectory_id",)) -> DataFrame:
    """``sample_sums`` whose total does not depend on the order of the positions.

    Each divergence is rounded to 18 decimals and summed as a decimal, which is exact, so any
    partitioning gives the same bits. ``kl_sum`` stays a decimal and may be summed on.
    """
    weight = F.when(F.col("kl").isNotNull(), F.col("loss_mask")).otherwise(0)
    value = F.coalesce(F.col("kl"), F.lit(0.0)).cast("decimal(28,18)")
    return positions.groupBy(*keys).agg(
        F.sum(F.when(weight == 1, value).otherwise((value * weight).cast("decimal(28,18)"))).alias("kl_sum"),
        F.sum(weight).alias("n_masked"),
    )


def exact_batch_loss(sums: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """``batch_loss`` from ``exact_sums``: the only rounding is that of the quotient."""
    return sums.groupBy(*keys).agg(F.sum("kl_sum").alias("_total"), F.sum("n_masked").alias("n_masked")).select(
        *keys, _mean(F.col("_total").cast("double"), F.col("n_masked")), "n_masked"
    )


def roll_up_chunks(chunks: DataFrame) -> DataFrame:
    """Slices to trajectories."""
    return chunks.groupBy("trajectory_id").agg(
        F.sum("kl_sum").alias("kl_sum"), F.sum("n_masked").alias("n_masked"), F.count("*").alias("n_chunks")
    )


def sample_loss(sums: DataFrame) -> DataFrame:
    """Loss of each trajectory on its own."""
    return sums.withColumn("loss", _mean(F.col("kl_sum"), F.col("n_masked"))).drop("kl_sum")


def batch_loss(sums: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Loss of each batch over all its masked positions: long trajectories weigh more."""
    return sums.groupBy(*keys).agg(
        _mean(F.sum("kl_sum"), F.sum("n_masked")), F.sum("n_masked").alias("n_masked")
    )


def batch_mean_of_samples(
    sums: DataFrame, keys: Sequence[str] = ("batch_id",), accumulation_steps: int = 1
) -> DataFrame:
    """Loss of each batch as the plain mean over its trajectories, divided by the accumulation steps."""
    return sample_loss(sums).groupBy(*keys).agg(
        (F.avg("loss") / F.lit(accumulation_steps)).alias("loss"), F.count("*").alias("n_samples")
    )


def dense_teacher_positions(teacher: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """Dense teacher logits to top-k rows in format ``logits``."""
    return with_top_k(teacher, top_k_dense(F.col("logits"), k)).drop("logits").withColumn("format", F.lit(fixed.LOGITS))


def dense_loss(
    teacher: DataFrame, student: DataFrame, k: int = fixed.TOP_K, temperature: float = 1.0, *, partial: bool = False
) -> DataFrame:
    """Loss per trajectory when the teacher's logits are dense too.

    ``partial`` selects the teacher's k best without sorting the vocabulary; take it for large ones.
    """
    if partial:
        top = with_top_k_partial(teacher, "logits", k).withColumn("format", F.lit(fixed.LOGITS))
    else:
        top = dense_teacher_positions(teacher, k)
    return sample_loss(sample_sums(position_kl(gather_dense(top, student, temperature), temperature)))


def chosen_mask(loss_mask: Column, attention: Column) -> Column:
    """The loss mask where there is one, else the attention mask."""
    return F.coalesce(loss_mask, attention)


def mean_of_batches(batches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of batch losses; 0 if there are none."""
    return batches.groupBy(*keys).agg(
        (F.coalesce(F.sum("loss"), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias("avg_loss"),
        F.count("*").alias("n_batches"),
    )
