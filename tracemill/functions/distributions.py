"""Arithmetic on score arrays: log-sum-exp, teacher probabilities, sparse KL.

All of it runs on arrays of a row, in DOUBLE, with exponents shifted by the largest entry.
Lambdas use only their own arguments (see ``arrays``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill import fixed


def as_doubles(values: Column) -> Column:
    return values.cast("array<double>")


def scaled(values: Column, temperature: float) -> Column:
    """Entries divided by a temperature that is fixed for the job."""
    values = as_doubles(values)
    return values if temperature == 1.0 else F.transform(values, lambda x: x / F.lit(float(temperature)))


def log_sum_exp(values: Column) -> Column:
    """ln of the summed exponentials of an array of doubles."""
    return F.aggregate(
        values,
        F.struct(F.array_max(values).alias("top"), F.lit(0.0).alias("mass")),
        lambda acc, x: F.struct(
            acc["top"].alias("top"),
            (acc["mass"] + F.exp(x - acc["top"])).alias("mass"),
        ),
        lambda acc: acc["top"] + F.ln(acc["mass"]),
    )


def teacher_exponents(values: Column, score_format: Column, temperature: float) -> Column:
    """Teacher scores as exponents: raw logits are divided by T, log-probabilities are not."""
    return F.when(score_format == fixed.LOGITS, scaled(values, temperature)).otherwise(as_doubles(values))


def probabilities(exponents: Column) -> Column:
    """Exponents to probabilities that sum to 1 over the array."""
    normaliser = F.array_repeat(log_sum_exp(exponents), F.size(exponents))
    return F.zip_with(exponents, normaliser, lambda x, n: F.exp(x - n))


@F.arrow_udf(T.DoubleType())
def _pair_sums(exponents: pa.Array, student_logp: pa.Array) -> pa.Array:
    """``sparse_kl`` of a batch, each row's pairs summed in their order."""
    n = len(exponents)
    sizes = pc.list_value_length(exponents).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    others = pc.list_value_length(student_logp).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    u, q = exponents.flatten(), student_logp.flatten()
    row = np.repeat(np.arange(n), sizes)
    starts = np.cumsum(sizes) - sizes
    if np.array_equal(sizes, others):
        at, there = slice(None), np.ones(len(row), bool)
    else:
        # Entries without a partner count as NULL.
        place = np.arange(len(row)) - starts[row]
        there = place < others[row]
        at = np.where(there, (np.cumsum(others) - others)[row] + place, 0)
        q = q if len(q) else pa.array([None], q.type)
    log_q, known = (x[at] for x in (q.fill_null(0.0).to_numpy(zero_copy_only=False), q.is_valid().to_numpy(zero_copy_only=False)))
    u_null = u.is_null().to_numpy(zero_copy_only=False)
    values = u.fill_null(0.0).to_numpy(zero_copy_only=False)
    filled = sizes > 0
    top = np.zeros(n)
    if filled.any():
        top[filled] = np.maximum.reduceat(values, starts[filled])
    with np.errstate(all="ignore"):
        shifted = values - top[row]
        w = np.exp(shifted)
        terms = np.where(w == 0.0, 0.0, w * (shifted - log_q))
        mass, cross = (np.bincount(row, weights=x, minlength=n) for x in (w, terms))
        kl = cross / mass - np.log(mass)
    unknown = np.bincount(row, weights=u_null | (~(known & there) & (w != 0.0)), minlength=n) > 0
    absent = ~filled | (others > sizes) | unknown | student_logp.is_null().to_numpy(zero_copy_only=False)
    return pa.array(kl, pa.float64(), mask=absent)


def sparse_kl(exponents: Column, student_logp: Column) -> Column:
    """Sum of p (ln p - ln q), with p the normalised exponents and ln q given per entry.

    With d = u - max u, w = exp(d) and S = sum w this is sum(w (d - ln q)) / S - ln S, so one
    pass over the pairs is enough. Entries with p = 0 add nothing. NULL if any ln q is NULL.
    Whole batches of rows are summed at once, as array functions cost several times the join before.
    """
    return _pair_sums(as_doubles(exponents), as_doubles(student_logp))
