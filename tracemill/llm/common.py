"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word rule: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once.

    The optimiser may merge a projection into lambdas of the next one, which would repeat the
    work for every element; a lambda's own argument is never repeated.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words between white space; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from batches that are sorted by ``keys``."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        new = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        new[0] = not held or (held[-1][keys].iloc[-1] != batch[keys].iloc[0]).any()
        if not new.any():
            held.append(batch)
            continue
        last = new.nonzero()[0][-1]
        head = [*held, batch.iloc[:last]] if last else held
        if head:
            yield pd.concat(head, ignore_index=True)
        held = [batch.iloc[last:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def group_starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Positions at which the groups of a sorted frame start, and its length."""
    new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
    new[0] = True
    return np.append(new.nonzero()[0], len(frame))


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
