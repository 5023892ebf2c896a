"""What the operators share: inputs by path, words, and bounded memories of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A to Z and the same letters in lower case; other letters stay as they are.
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space between words.
WORD_SPACE = "[\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: str) -> str:
    """``text`` with A-Z in lower case and nothing else changed."""
    return text.lower() if text.isascii() else text.encode("utf-8").lower().decode("utf-8")


class Memory(dict):
    """A dict that keeps the recently used of at most ``2 * size`` entries.

    Entries in use move from the old to the young half; when the young half is
    full it becomes the old one. A task that meets ever new keys stays bounded.
    """

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self._make, self._size, self._old = make, size, {}

    def __missing__(self, key):
        value = self._old.get(key)
        return self.put(key, self._make(key) if value is None else value)

    def put(self, key, value):
        if len(self) >= self._size:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value

    def peek(self, key):
        """The remembered value, or None; nothing is made."""
        value = self.get(key)
        if value is None and (value := self._old.get(key)) is not None:
            self.put(key, value)
        return value


def list_offsets(lists: pa.ListArray) -> pa.Array:
    """Offsets from 0 of the lengths of ``lists``, which has no nulls."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def blocks_by_length(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values have about ``most`` bytes or items together, one row at least."""
    values = batch.column(column)
    is_list = pa.types.is_list(values.type)
    lengths = pc.list_value_length(values) if is_list else pc.binary_length(values)
    ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
        end = max(end, start + 1)
        yield batch.slice(start, end - start)
        start = end


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict] | dict]], schema: str
) -> DataFrame:
    """Runs ``make()(batch)`` over the Arrow batches of each task; the results are columns by name.

    ``make`` is called once per task, so what it opens or remembers lives as long as the task.
    """
    from pyspark.sql.types import StructType

    names = [f.name for f in StructType.fromDDL(schema)]
    target = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                for columns in [made] if isinstance(made, dict) else made:
                    arrays = [
                        columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n], target.field(n).type)
                        for n in names
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


#: Rows of up to so many bytes that are sent to all tasks; a larger side is joined by shuffle.
BROADCAST_BYTES = 24 << 20


def sized(table: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a written table for broadcast if its rows, counted, stay below a fixed size."""
    from pyspark.sql import functions as F

    return F.broadcast(table) if table.count() * row_bytes <= most else table
