"""Ordered folds over the rows of a key, in bounded memory.

Rows are dealt by key and sorted within partitions; each task then reads its
rows once, in batches, and carries the state of the current key only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, by: list[str], order: list[str], added: str, start: Callable[[], Any], step: Callable[[Any, Any], tuple[Any, tuple]]) -> DataFrame:
    """Adds the columns ``added`` (a schema string): each row's outputs of a fold.

    ``step`` takes (state, row) and returns (new state, outputs); ``start`` makes
    the state of a key's first row.  ``order`` must settle all ties.
    """
    names = [x.split()[0] for x in added.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            outputs = []
            for row in frame.itertuples(index=False):
                now = tuple(getattr(row, c) for c in by)
                if now != key:
                    key, state = now, start()
                state, out = step(state, row)
                outputs.append(out)
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(outputs, columns=names, dtype=object)], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, f"{fields}, {added}")
