"""Sums of arrays that tasks have made, by key, in bounded memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sums): the float64 arrays of bytes ``sums`` added up by whole-number keys; a task holds one array at a time."""
    kinds = ", ".join(f"{k} {t}" for k, t in parts.select(*keys).dtypes) + ", sums binary"

    def row(key, total) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32()) for k, v in zip(keys, key)} | {"sums": pa.array([total.tobytes()], pa.binary())})

    def work(batches):
        key, total = None, 0
        for batch in batches:  # in order of the keys
            for *own, data in zip(*(batch.column(i).to_pylist() for i in range(len(keys) + 1))):
                if own != key:
                    if key is not None:
                        yield row(key, total)
                    key, total = own, 0
                total = total + np.frombuffer(data)
        if key is not None:
            yield row(key, total)

    return parts.select(*keys, "sums").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, kinds)
