"""Run a function over Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Text handed to the function at once.
BATCH_BYTES = 8 << 20


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow with batches cut to about BATCH_BYTES, so that memory does not depend on text lengths.

    The function gives one batch or, where its result is much larger than what it reads, several in turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
            for a in range(0, batch.num_rows, step):
                out = function(batch.slice(a, step))
                yield from (b for b in ([out] if isinstance(out, pa.RecordBatch) else out) if b.num_rows)

    return df.mapInArrow(run, schema)
