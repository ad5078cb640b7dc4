"""Walking Arrow batches text by text and in slices of bounded size, on the executors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 18
BATCH_BYTES = 1 << 22
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def modest(df: DataFrame) -> DataFrame:
    """`df`. From now on the Arrow batches of its session hold about BATCH_BYTES, unless the session sets another size: ten
    thousand rows of long texts are too many for a worker and its executor."""
    conf = df.sparkSession.conf
    if conf.get(BATCH, None) is None:
        conf.set(BATCH, str(BATCH_BYTES))
    return df


def texts(column: pa.Array) -> Iterator[str]:
    """Each value as str; null is empty, bytes that are no UTF-8 become U+FFFD."""
    raw = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    for value in raw:
        data = value.as_py()
        yield "" if data is None else data.decode("utf-8", "replace")


def slices(batches: Iterable[pa.RecordBatch], name: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a slice hold `most` bytes, or are one text alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = raw_bytes(batch.column(name))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and len + 1 offsets into them; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ends
