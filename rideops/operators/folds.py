"""Sequential folds: for rules in which a decision depends on the decisions before it.

Rows are hashed by key, sorted inside each partition and streamed through ``mapInPandas``. A
fold keeps only its state, never a group, so a key with very many rows costs time in one task
but no memory. Where the rule allows it the key includes a session, which splits such keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                new_state: Callable[[], object], step: Callable[[object, object], list[tuple]], schema: str) -> DataFrame:
    """Call ``step(state, row)`` on every row in key and time order; it returns output rows.

    A new state starts at every new key. Output columns follow ``schema``.
    """
    key_at = [df.columns.index(k) for k in keys]
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out: list[tuple] = []
            columns = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in batch.columns]
            for row in zip(*columns):
                key = tuple(row[i] for i in key_at)
                if key != current:
                    current, state = key, new_state()
                out.extend(step(state, row))
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
