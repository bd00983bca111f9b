"""Sums of small numpy arrays over a table: partial sums in the scanning tasks, a second level of tasks, then the driver.

What travels is one packed array for each key and task, so that forty features cost one array of 820 products instead of
820 aggregate expressions; what reaches the driver is at most `FAN` arrays for each key, whatever the table.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

# Arrays of one key that reach the driver.
FAN = 16

# Functions sent to executors carry their code.
cloudpickle.register_pickle_by_value(sys.modules["duelframe.operators"])


def upper(d: int) -> tuple:
    """Row and column numbers of a packed upper triangle."""
    return np.triu_indices(d)


def unpack(packed: np.ndarray, d: int) -> np.ndarray:
    full = np.zeros((d, d))
    full[upper(d)] = packed
    return full + np.triu(full, 1).T


def matrix(column) -> np.ndarray:
    """A column of equally long lists of numbers as an array of rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _rows(sums: dict):
    keys = sorted(sums)
    flat = np.concatenate([sums[k] for k in keys]) if keys else np.zeros(0)
    offsets = np.cumsum([0, *[len(sums[k]) for k in keys]])
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["k", "v"])


def summed(rows: DataFrame, of_batch) -> dict:
    """{key: array}: the sum over all Arrow batches of the arrays that `of_batch(batch)` returns as {key: array}."""
    def partial(batches):
        sums: dict = {}
        for batch in batches:
            if batch.num_rows:
                for k, v in of_batch(batch).items():
                    sums[k] = sums[k] + v if k in sums else v
        yield _rows(sums)

    def joined(batches):
        sums: dict = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = v.values.to_numpy()
                sums[k] = sums[k] + v if k in sums else v
        yield _rows(sums)

    parts = rows.mapInArrow(partial, "k int, v array<double>").withColumn("salt", F.spark_partition_id() % FAN)
    second = parts.repartition(FAN, "salt").select("k", "v").mapInArrow(joined, "k int, v array<double>")
    out: dict = {}
    for r in second.collect():
        v = np.array(r.v)
        out[r.k] = out[r.k] + v if r.k in out else v
    return out
