"""Fragments of several words that two tables share, with no text shuffled but of fragments whose hashes both tables hold.

A bitmap of 64-bit hashes first rules out, where they are made, most fragments of the
shown table that the protected one can't hold. Of the rest and of the protected table,
32-bit codes meet by ranges of the hashes, four bytes for a fragment. Fragments with a
code that both hold are then read again and meet as text, so a hash never decides.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.scratch import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

#: Bits of a slice of a bitmap, and of the largest bitmap: 32 MB.
SLICE, MOST_BITS = 1 << 22, 1 << 28
#: Fragments of one batch that a task hands on; codes that a task holds, or a range of hashes, at most or about.
BATCH, CODES = 50_000, 1 << 21
#: Shared codes that are sent to all tasks as they are (32 MB); more of them are sent as a bitmap.
SENT = 1 << 22
#: Shared fragments whose texts are broadcast.
BROADCAST_ROWS = 200_000
#: Bytes that are hashed at once.
STRETCH = 1 << 16
_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xFF51AFD7ED558CCD)  # any odd numbers
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _once(parts: list, kind: type) -> np.ndarray:
    """Numbers of several arrays, sorted and each once; sorting is faster than np.unique."""
    out = np.concatenate([np.empty(0, kind), *parts])
    out.sort()
    return out[np.concatenate([np.ones(len(out[:1]), bool), out[1:] != out[:-1]])]


class _Hasher:
    """Hashes of all fragments of a column of texts; words are parted by [\\x20\\x09-\\x0D]+."""

    def __init__(self, size: int):
        self.size = size
        self.values = np.random.default_rng(42).integers(1, 1 << 64, 256, np.uint64)
        self.blank = np.zeros(256, bool)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True
        self.values[self.blank] = 0
        self.up, self.down = _powers(_ODD, STRETCH), _powers(pow(_ODD, -1, 1 << 64), STRETCH)

    def _words(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The hash of the word at each start: its bytes' values times powers, summed."""
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = len(starts) if len(data) - starts[i] <= STRETCH else max(i + 1, int(np.searchsorted(starts, starts[i] + STRETCH, "right")) - 1)
            part = data[starts[i] : starts[j] if j < len(starts) else len(data)]
            at = starts[i:j] - starts[i]
            out[i:j] = np.add.reduceat(self.values[part] * (self.up if len(part) <= STRETCH else _powers(_ODD, len(part)))[: len(part)], at) * self.down[at]
            i = j
        return (out ^ (out >> np.uint64(32))) * _MIX

    def __call__(self, texts: pa.Array) -> None:
        """Sets data (bytes), starts (of words), first (a fragment's first word), row (its text) and hash."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        held = texts.buffers()[2] if len(texts) else None
        data = np.empty(0, np.uint8) if held is None else np.frombuffer(held, np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        self.data, self.edges = data, edges
        blank = self.blank[data]
        begins = np.ones(len(data), bool)
        begins[1:] = blank[:-1]
        begins[edges[edges < len(data)]] = True
        self.starts = np.flatnonzero(begins & ~blank)
        words = self._words(data, self.starts)
        row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.starts, edges)))
        n = max(0, len(words) - self.size + 1)
        self.first = np.flatnonzero(row[:n] == row[self.size - 1 :]) if n else np.empty(0, np.int64)
        out = np.zeros(n, np.uint64)
        for i in range(self.size):
            out = out * np.uint64(_ODD) + words[i : n + i]
        out = out[self.first]
        out = (out ^ (out >> np.uint64(33))) * _MIX
        self.hash, self.row = out ^ (out >> np.uint64(33)), row[self.first]

    def gram(self, i: int) -> bytes:
        """The text of a fragment, its words joined by single spaces."""
        after, end = self.first[i] + self.size, self.edges[self.row[i] + 1]
        if after < len(self.starts):
            end = min(end, self.starts[after])
        return b" ".join(self.data[self.starts[self.first[i]] : end].tobytes().split())


def _texts(rows: DataFrame) -> DataFrame:
    """Batches of long texts stay small."""
    if rows.sparkSession.conf.get(_ROWS, None) is None:
        rows.sparkSession.conf.set(_ROWS, "1000")
    return rows


def _hashes(rows: DataFrame, size: int) -> DataFrame:
    """Column hash: those of the texts' fragments, each once a batch, as blocks of 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Hasher(size)
        for batch in batches:
            made(batch.column("text"))
            found = _once([made.hash], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([found[i : i + CODES].tobytes() for i in range(0, len(found), CODES)], pa.binary())], names=["hash"])

    return _texts(rows.select("text")).mapInArrow(run, "hash binary")


def _bitmap(hashes: DataFrame, expected: int) -> np.ndarray:
    """A bit for each hash of blocks, in 16 bits for each one expected up to ``MOST_BITS`` in all; it knows every hash."""
    bits = min(MOST_BITS, max(1 << 15, 1 << max(0, 16 * expected - 1).bit_length()))
    slices = max(1, bits // SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for block in (b for batch in batches for b in batch.column("hash")):
            held.append((np.frombuffer(block.as_py(), np.uint64) & np.uint64(bits - 1)).astype(np.uint32))
            n += len(held[-1])
            if n >= CODES:
                yield _parted(held, slices, bits // slices)
                held, n = [], 0
        yield _parted(held, slices, bits // slices)

    def whole(part: pa.Table) -> pa.Table:
        out = np.zeros(bits // slices, bool)
        for c in part.column("codes"):
            out[np.frombuffer(c.as_py(), np.uint32)] = True
        return pa.table({"range": part.column("range")[:1], "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((slices, bits // slices // 8), np.uint8)
    for r in hashes.mapInArrow(run, "range int, codes binary").groupBy("range").applyInArrow(whole, "range int, bits binary").toLocalIterator():
        out[r["range"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _parted(held: list, ranges: int, width: int) -> pa.RecordBatch:
    """range, codes: numbers, sorted and each once, by ranges of so many; a code of 32 bits is the place in its range."""
    codes = _once(held, np.uint32)
    at = np.searchsorted(codes, np.arange(1, ranges, dtype=np.uint64) * np.uint64(width))
    cut = [(i, (p % p.dtype.type(width)).astype(np.uint32).tobytes()) for i, p in enumerate(np.split(codes, at)) if len(p)]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in cut], pa.int32()), pa.array([c for _, c in cut], pa.binary())], names=["range", "codes"])


def _told(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which of the hashes the bitmap knows."""
    at = hashes & np.uint64(len(bitmap) * 8 - 1)
    return ((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _codes(rows: DataFrame, size: int, ranges: int, bitmap: np.ndarray | None = None) -> DataFrame:
    """range, codes: the first ``ranges`` bits of hashes and, sorted, the 32 bits that follow, each once a block of a task."""
    sent = None if bitmap is None else rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, n = _Hasher(size), [], 0
        for batch in batches:
            made(batch.column("text"))
            found = made.hash if sent is None else made.hash[_told(made.hash, sent.value)]
            held.append(found >> np.uint64(32 - ranges))
            n += len(found)
            if n >= CODES:
                yield _parted(held, 1 << ranges, 1 << 32)
                held, n = [], 0
        yield _parted(held, 1 << ranges, 1 << 32)

    return _texts(rows.select("text")).mapInArrow(run, "range int, codes binary")


def _shared_codes(shown: DataFrame, protected: DataFrame) -> DataFrame:
    """Column hash: blocks of 64-bit numbers, range and code, of which both tables have a fragment."""

    def all_of(table: pa.Table) -> np.ndarray:
        return _once([np.frombuffer(c.as_py(), np.uint32) for c in table.column("codes")], np.uint32)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        both = np.empty(0, np.uint64)
        if len(left) and len(right):
            both = np.intersect1d(all_of(left), all_of(right), assume_unique=True).astype(np.uint64) + np.uint64(left.column("range")[0].as_py() << 32)
        return pa.table({"hash": pa.array([both.tobytes()] if len(both) else [], pa.binary())})

    return shown.groupBy("range").cogroup(protected.groupBy("range")).applyInArrow(meet, "hash binary")


def _left(rows: DataFrame, key: str, size: int, bitmap: np.ndarray, codes: np.ndarray | None = None, drop: int = 0) -> DataFrame:
    """key, hash, gram: the fragments, each once a row, whose hash without its last ``drop`` bits the bitmap knows, and the sorted codes have if they are given."""
    sent = rows.sparkSession.sparkContext.broadcast((bitmap, codes))
    kind = rows.schema[key]

    def made(keys: list, hashes: list, grams: list, keys_type: pa.DataType) -> pa.RecordBatch:
        texts = pa.array(grams, pa.binary())
        texts = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers())  # as the table has them, valid UTF-8 or not
        return pa.RecordBatch.from_arrays([pa.array(keys, keys_type), pa.array(hashes, pa.int64()), texts], names=["key", "hash", "gram"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = sent.value
        found = _Hasher(size)
        for batch in batches:
            found(batch.column("text"))
            cut = found.hash >> np.uint64(drop)
            hit = np.flatnonzero(_told(cut, bits))
            if known is not None:
                at = np.minimum(np.searchsorted(known, cut[hit]), len(known) - 1)
                hit = hit[known[at] == cut[hit]]
            keys, hashes, grams, own, row = [], [], [], set(), -1
            column = batch.column("key")
            for i, r, h in zip(hit.tolist(), found.row[hit].tolist(), found.hash[hit].view(np.int64).tolist()):
                if r != row:
                    if len(keys) >= BATCH:
                        yield made(keys, hashes, grams, column.type)
                        keys, hashes, grams = [], [], []
                    own, row, k = set(), r, column[r].as_py()
                gram = found.gram(i)
                if gram not in own:
                    own.add(gram)
                    keys.append(k)
                    hashes.append(h)
                    grams.append(gram)
            yield made(keys, hashes, grams, column.type)

    return _texts(rows.select(F.col(key).alias("key"), "text")).mapInArrow(run, f"key {kind.dataType.simpleString()}, hash long, gram string")


def _met(shown: DataFrame, protected: DataFrame, key: str, size: int) -> DataFrame:
    """key, id, gram: shared fragments, each once a row of the shown table at least; id is one for each gram."""
    size_of = lambda rows: rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    likely = size_of(protected) // 5  # a fragment for each word, of four bytes and a blank
    bitmap = _bitmap(_hashes(protected, size), likely)
    passed = size_of(shown) // 5 * int(np.bitwise_count(bitmap).sum(dtype=np.int64)) // (len(bitmap) * 8)
    ranges = min(20, max(0, ((likely + passed) // CODES).bit_length()))
    codes = kept(_shared_codes(_codes(shown, size, ranges, bitmap), _codes(protected, size, ranges)))
    n = codes.agg(F.coalesce(F.sum(F.octet_length("hash")), F.lit(0))).first()[0] // 8
    if n == 0:
        return shown.select(F.col(key).alias("key"), F.lit(0).alias("id"), F.col("text").alias("gram")).limit(0)
    if n <= SENT:
        exact = np.sort(np.frombuffer(b"".join(r["hash"] for r in codes.toLocalIterator()), np.uint64))
        bits = min(MOST_BITS, max(1 << 15, 1 << (64 * n - 1).bit_length()))
        flags = np.zeros(bits // 8, np.uint8)
        at = exact & np.uint64(bits - 1)
        np.bitwise_or.at(flags, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    else:
        exact, flags = None, _bitmap(codes, n)
    held = _left(shown, key, size, flags, exact, 32 - ranges).select("key", "gram")
    sure = _left(protected.select(F.lit(0).alias("one"), "text"), "one", size, flags, exact, 32 - ranges).select("gram").distinct()
    if n > BROADCAST_ROWS:
        return held.join(sure, "gram", "left_semi").select("key", F.col("gram").alias("id"), "gram")
    sure = kept(sure).withColumn("id", F.monotonically_increasing_id())
    return held.join(F.broadcast(sure), "gram").select("key", "id", "gram")


def shared_fragments(shown: DataFrame, protected: DataFrame, key: str, size: int = 8) -> DataFrame:
    """O-E12: key, gram: each fragment of ``size`` words of a shown row's text that stands in a protected text.

    Both tables have a column text; nulls and texts of fewer words have no fragments.
    """
    return _met(shown, protected, key, size).select(F.col("key").alias(key), "gram").distinct()


def shared_counts(shown: DataFrame, protected: DataFrame, key: str, size: int = 8) -> DataFrame:
    """O-E12: key, n_fragments: how many different ones, of keys that have any."""
    return _met(shown, protected, key, size).select(F.col("key").alias(key), "id").distinct().groupBy(key).agg(F.count("*").alias("n_fragments"))
