"""Ordered folds: one state for each key, carried over its rows in order.

Rows are dealt by key and sorted by Spark (which spills), then streamed through in Arrow batches;
a task holds one state at a time, never a key's whole history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], reads: list[str], step: Callable, adds: str) -> DataFrame:
    """step(state, *values of reads) gives (state, tuple for the columns in adds); a key begins with None."""
    extra: StructType = _parse_datatype_string(adds)
    schema = StructType([*df.schema.fields, *extra.fields])
    names = [f.name for f in extra.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, values in zip(zip(*(batch[c].tolist() for c in keys)), zip(*(batch[c].tolist() for c in reads)), strict=True):
                if k != key:
                    key, state = k, None
                state, row = step(state, *values)
                out.append(row)
            added = pd.DataFrame(out, columns=names, dtype=object)
            yield pd.concat([batch.reset_index(drop=True), added], axis=1)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
