"""Cutting Arrow batches by bytes, and long texts where no token can span the cut."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that a task handles at a time, about.
CHUNK_BYTES = 500_000

#: Bytes of an Arrow batch between Spark and Python, at most; each task holds one on either side.
BATCH_BYTES = 8_000_000

#: Between two word characters a single blank starts a new token: the pre-tokenizers used here join a blank to
#: the word after it or drop it, and never join a word to the blank after it.
_SAFE = re.compile(r"(?<=\w) (?=\w)")


def bounded(df: DataFrame) -> DataFrame:
    """The same rows, in a session whose Arrow batches have ``BATCH_BYTES`` bytes at most: rows here are whole texts."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``limit`` bytes; a longer text is a run of its own."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes.astype("int64")) // limit
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def safe_parts(text: str, limit: int) -> Iterator[str]:
    """The text in parts of about ``limit`` characters, cut at safe places only; without one, in longer parts."""
    start = 0
    while len(text) - start > limit:
        found = _SAFE.search(text, start + limit)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]
