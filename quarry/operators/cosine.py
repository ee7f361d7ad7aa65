"""Cosines within a partition by blocks: products of matrices, in cells that are a pair of blocks each.

A partition of n vectors is cut into about sqrt(n / 1024) blocks by id, so a cell's size
and the copies of a block both grow with the square root. A cell is screened in single
precision with the error's bound as a margin; what the screen can't tell is computed in
double precision. NaN counts as at least any threshold, as in Spark's comparisons.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

#: Vectors of the largest block; products of one step of a cell; hits computed at once.
BLOCK, PRODUCTS, HITS = 16_384, 1 << 22, 1 << 16


def cells(vectors: DataFrame, id_col: str, vec_col: str, part_col: str, blocks: int | None = None) -> DataFrame:
    """Rows (part, dim, i, j, block, held): each block of vectors once for each cell (i, j) that it is in.

    ``held`` is a list of (id, v) and the columns of ``vectors`` beyond the three. Rows with a null id,
    partition, vector or element have no cosine and are left out; vectors of different sizes never meet.
    """
    more = [c for c in vectors.columns if c not in (id_col, vec_col, part_col)]
    rows = vectors.select(F.col(part_col).alias("part"), F.col(id_col).alias("id"), F.col(vec_col).alias("v"), *more)
    rows = rows.filter("part IS NOT NULL AND id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    n = F.count("*")
    needed = F.greatest(F.ceil(F.sqrt(n / 1024)), F.ceil(n / BLOCK)) if blocks is None else F.lit(blocks)
    sizes = rows.groupBy("part").agg(needed.cast("long").alias("blocks"))
    placed = rows.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("dim", F.size("v"))
    held = placed.groupBy("part", "dim", "block", "blocks").agg(F.collect_list(F.struct("id", "v", *more)).alias("held"))
    spread = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return spread.select("part", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "held")


def map_cells(met: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over each cell's two blocks (arrays of structs; None for the second of a cell i = i)."""

    def mapped(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = key[2].as_py(), key[3].as_py()
        sides = [s.values for batch in batches for s in batch.column("held")]
        if i == j or len(sides) == 2:  # a block without rows has none
            yield from run(key[0], *(sides if i != j else [sides[0], None]))

    return met.groupBy("part", "dim", "i", "j").applyInArrow(mapped, schema)


def _units(side: pa.StructArray) -> np.ndarray:
    flat = side.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(side), len(flat) // len(side))
    with np.errstate(invalid="ignore"):
        return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]


def _hits(x: np.ndarray, y: np.ndarray | None, at_least: float, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Places i in x and j in y (y None: in x, i < j) whose cosine is at least ``at_least``, and with ``exact`` the cosines."""
    same, y = y is None, x if y is None else y
    x4, y4 = x.astype(np.float32), y.astype(np.float32)
    margin = (x.shape[1] + 4) * 2.0**-22
    step = max(1, PRODUCTS // len(y))
    with np.errstate(invalid="ignore"):
        for start in range(0, len(x), step):
            first = start if same else 0
            told = x4[start : start + step] @ y4[first:].T
            i, j = np.nonzero(~(told < at_least - margin))
            about = told[i, j]
            i, j = i + start, j + first
            if same:
                i, j, about = i[i < j], j[i < j], about[i < j]
            for k in range(0, len(i), HITS):
                a, b, near = i[k : k + HITS], j[k : k + HITS], about[k : k + HITS]
                if exact:
                    cosine = np.einsum("ij,ij->i", x[a], y[b])
                    kept = ~(cosine < at_least)
                    yield a[kept], b[kept], cosine[kept]
                else:
                    kept, doubtful = np.ones(len(a), bool), np.flatnonzero(~(near > at_least + margin))
                    kept[doubtful] = ~(np.einsum("ij,ij->i", x[a[doubtful]], y[b[doubtful]]) < at_least)
                    yield a[kept], b[kept], None


def pairs_of(at_least: float) -> Callable:
    """Of a cell: batches (part, a, b, cosine), a < b."""

    def run(part: pa.Scalar, one: pa.StructArray, two: pa.StructArray | None) -> Iterator[pa.RecordBatch]:
        ids = [one.field("id"), (one if two is None else two).field("id")]
        for i, j, cosine in _hits(_units(one), None if two is None else _units(two), at_least, True):
            a, b = ids[0].take(pa.array(i)), ids[1].take(pa.array(j))
            less = pc.less(a, b)
            ends = [pc.if_else(less, a, b), pc.if_else(less, b, a)]
            made = pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(i), part.type), *ends, pa.array(cosine)], names=["part", "a", "b", "cosine"])
            yield made.filter(pc.not_equal(a, b))

    return run


class _Texts:
    """Token sets as hashes and lengths of a cell's rows."""

    def __init__(self, sides: list[pa.StructArray], least_jaccard: float, most_ratio: float):
        lists = [s.field("tokens") for s in sides]
        self.sizes = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists])
        self.ends = np.cumsum(np.concatenate([[0], self.sizes]))
        told, self.codes = np.unique(np.concatenate([x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]), return_inverse=True)
        self.flags = np.zeros(len(told), bool)
        self.lengths = np.concatenate([s.field("n_chars").to_numpy(zero_copy_only=False).astype(np.float64) for s in sides])
        self.least_jaccard, self.most_ratio = least_jaccard, most_ratio

    def confirmed(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of the others those whose token set and length are like those of i."""
        low, high = np.minimum(self.lengths[i], self.lengths[others]), np.maximum(self.lengths[i], self.lengths[others])
        with np.errstate(invalid="ignore", divide="ignore"):
            others = others[np.where(high == 0, 1.0, high / low) <= self.most_ratio]
        if not len(others):
            return others
        mine = self.codes[self.ends[i] : self.ends[i + 1]]
        self.flags[mine] = True
        shared = np.concatenate([[0], np.cumsum(self.flags[np.concatenate([self.codes[self.ends[j] : self.ends[j + 1]] for j in others.tolist()])])])
        self.flags[mine] = False
        ends = np.cumsum(np.concatenate([[0], self.sizes[others]]))
        both = shared[ends[1:]] - shared[ends[:-1]]
        union = self.sizes[i] + self.sizes[others] - both
        return others[np.where(union == 0, 1.0, both / np.maximum(union, 1)) >= self.least_jaccard]


def links_of(at_least: float, least_jaccard: float | None = None, most_ratio: float | None = None) -> Callable:
    """Of a cell: one batch (a, b) of edges whose components are those of all its pairs.

    A pair whose ends are connected already needs no look at its texts, and a group of
    m rows gives m - 1 edges, however many pairs it has.
    """

    def run(part: pa.Scalar, one: pa.StructArray, two: pa.StructArray | None) -> Iterator[pa.RecordBatch]:
        sides = [one] if two is None else [one, two]
        ids = pa.concat_arrays([s.field("id") for s in sides])
        texts = None if least_jaccard is None else _Texts(sides, least_jaccard, most_ratio)
        group, shift = np.arange(len(ids)), 0 if two is None else len(one)
        for i, j, _ in _hits(_units(one), None if two is None else _units(two), at_least, False):
            j = j + shift
            apart = group[i] != group[j]
            i, j = i[apart], j[apart]
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            for k, end in zip(starts.tolist(), [*starts[1:].tolist(), len(i)]):
                at, others = int(i[k]), j[k:end]
                others = others[group[others] != group[at]]
                if texts is not None and len(others):
                    others = texts.confirmed(at, others)
                if len(others):
                    group[np.isin(group, group[others])] = group[at]
        moved = np.flatnonzero(group != np.arange(len(ids)))
        a, b = ids.take(pa.array(group[moved])), ids.take(pa.array(moved))
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pc.not_equal(a, b))

    return run
