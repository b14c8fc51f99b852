"""Folds over a key's rows in order, for what depends on the last result and not on the last row, so that no window expresses it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def scanned(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, tuple], list[tuple]], kind: str) -> DataFrame:
    """What ``step(state, row)`` gives for each row, keys by keys and in order within; ``start()`` makes a key's state, which step changes.

    Rows are dealt by their keys and sorted within each task, and pass through it a batch at a time: a task holds one state and one batch, however long a key's history is.
    Rows reach step as named tuples. ``kind`` is the schema of the tuples that it returns. Null keys are a key like any other.
    """
    columns = [f.partition(":")[0].split()[0] for f in kind.split(", ")]
    names = {c: rows.columns.index(c) for c in keys}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False):
                own = tuple(None if pd.isna(row[i]) else row[i] for i in names.values())
                if own != at or state is None:
                    at, state = own, start()
                out += step(state, row)
            yield pd.DataFrame(out, columns=columns)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, kind)
