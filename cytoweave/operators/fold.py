"""Ordered folds over sorted partitions: many small groups in one Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame


def deal(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """Rows of a key side by side in one partition, in order."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def in_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fold`` over blocks of whole groups, as many as an Arrow batch holds.

    A group that lies over the end of a batch waits for the next one, so a block
    is never larger than a batch and a group.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            ends = (batch[keys] != batch[keys].iloc[-1]).any(axis=1).to_numpy()
            cut = int(np.flatnonzero(ends)[-1]) + 1 if ends.any() else 0
            apart = kept and (kept[-1][keys].iloc[-1] != batch[keys].iloc[0]).any()
            if cut or apart:  # what was kept back is whole
                yield fold(pd.concat([*kept, batch.iloc[:cut]], ignore_index=True))
                kept = []
            kept.append(batch.iloc[cut:])
        if kept:
            yield fold(pd.concat(kept, ignore_index=True))

    return deal(rows, keys, order).mapInPandas(run, schema)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted columns, as places; the first is 0."""
    n = len(columns[0])
    fresh = np.zeros(n, bool)
    if n:
        fresh[0] = True
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)
