"""Blocks of texts in a task: bounded parts of Arrow batches, and their words as one numbered list."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quarry.llm.shared import ship

ship(__name__)

#: Rows of a batch that Spark hands to a task's Python, where the session doesn't say: whole texts may be long.
BATCH_ROWS = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Text of one block, in bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def map_arrow(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """``rows.mapInArrow`` in batches of ``BATCH_ROWS`` (set for the session unless it has its own bound).

    When a task ends, its worker gives freed memory back: workers stay for later stages.
    """
    if rows.sparkSession.conf.get(_ROWS, None) is None:
        rows.sparkSession.conf.set(_ROWS, str(BATCH_ROWS))

    def mapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)

    return rows.mapInArrow(mapped, schema)


def parts(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batch whose ``column`` (strings or binaries) holds at most ``most`` bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words parted by ``[\\x20\\x09-\\x0D]+``: for each word of the block its number among the
    distinct ones, those as binaries, and for each text (one more at the end) where its words start.

    Null and blank texts have no words. With ``lower`` A-Z alone become a-z.
    """
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
    words = lists.flatten()
    if blank.any():  # a blank text is split into one empty word
        words, counts = words.filter(pc.greater(pc.binary_length(words), 0)), np.where(blank, 0, counts)
    told = words.cast(pa.binary()).dictionary_encode()
    return told.indices.to_numpy(zero_copy_only=False), told.dictionary, np.cumsum([0, *counts], dtype=np.int64)
