"""What the corpus operators share: reading tables and walking Arrow batches in slices of bounded size.

Every operator takes a frame with an id column and a text column, looks at those two columns
only, and so is blind to extra columns and their names. A null text counts as an empty one
unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a task works on; the working memory of a step is a small multiple of it.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and Python; a batch is held twice on either side.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read, with no null text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches with a text column so that each has at most limit bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text_col))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column without nulls, and where each row starts and ends in them."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def map_slices(frame: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, limit: int = SLICE_BYTES, text_col: str = "text") -> DataFrame:
    """Run work on every slice of the frame's rows. Sets the session's limit on the bytes of an Arrow batch, which rows alone don't bound."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        for part in slices(batches, limit, text_col):
            if (out := work(part)) is not None:
                yield out

    return frame.mapInArrow(run, schema)
