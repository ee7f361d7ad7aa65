"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint has a bit set where more than half the weight of a text's
features has it. Each bit position is given a non-zero vector of ``radius + 1``
bits; table ``v`` keeps the positions whose vector has an odd inner product with
``v``. The vectors of ``radius`` differing positions cannot span the whole space,
so some ``v`` is orthogonal to them all: every pair within the radius collides in
at least one of the ``2 ** (radius + 1) - 1`` tables (Pagh, "Locality-sensitive
hashing without false negatives").

Null and empty texts have no features; their fingerprint is zero and links like
any other. Equal fingerprints are one node, so copies are never paired.

The pipeline's near-duplicate stage takes its first links from the fingerprints, and
an exact check of shingle sets confirms them. A Jaccard similarity of 0.8 moves more
bits than a radius of 2 holds, so pairs that these links don't connect meet exactly
as well, through the prefixes of their shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.blocks import map_arrow, parts, split_words
from quarry.llm.components import connected_components
from quarry.llm.shared import broadcast_if_small, commonest, materialise, row_key, ship, with_keys, without_keys

ship(__name__)

SEED = 42
#: Buckets up to this size are compared pair by pair; larger ones through exact hubs or representatives.
BUCKET = 64
_CHUNK = 1 << 16


def masks(radius: int, bits: int = 64) -> list[int]:
    """The covering tables' masks as signed 64-bit numbers."""
    size = (1 << (radius + 1)) - 1
    vectors = [i % size + 1 for i in range(bits)]
    found = [sum(1 << i for i in range(bits) if (vectors[i] & v).bit_count() % 2) for v in range(1, size + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _words(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII alone: A-Z and [\\x20\\x09-\\x0D]."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], n: int) -> Iterator[int]:
    """XXH64 of each n-word shingle, repeats included; of the whole sequence where it is shorter."""
    if len(words) < n:
        return iter([xxhash.xxh64_intdigest(b" ".join(words), seed=SEED)] if words else [])
    return (xxhash.xxh64_intdigest(s, seed=SEED) for s in map(b" ".join, zip(*(islice(words, i, None) for i in range(n)))))


def _majority(hashes: Iterator[int]) -> int:
    """Bits set in over half the hashes; chunks bound the memory of a very long text."""
    total, ones = 0, np.zeros(64, np.int64)
    while chunk := list(islice(hashes, _CHUNK)):
        bits = np.unpackbits(np.array(chunk, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones, total = ones + bits.sum(0, dtype=np.int64), total + len(chunk)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return _majority(shingle_hashes(_words(text), shingle))


def _mapped(docs: DataFrame, key: Column, text_col: str, outputs: list, fields: str) -> DataFrame:
    """Key and one 64-bit result of each function in ``outputs`` for each row's text."""
    rows = docs.select(key.alias("key"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = part.column("text")
                done = [[f(t.as_py()) for f in outputs] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array([d[i] for d in done], pa.int64()) for i in range(len(outputs)))], names=["key", *fields.split()])

    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *(T.StructField(f, T.LongType()) for f in fields.split())])
    return map_arrow(rows, run, schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Columns key (the id) and fp, one row for each input row."""
    return _mapped(docs, F.col(id_col), text_col, [lambda t: fingerprint(t, shingle)], "fp")


def _tables(nodes: DataFrame, key: str, radius: int) -> DataFrame:
    """Each node once for each covering table, with its masked fingerprint."""
    cells = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks(radius))])
    return nodes.select(key, F.explode(cells).alias("c")).select(key, "c.t", "c.cell")


def links(distinct: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``radius`` bits.

    ``distinct`` has one row for each fingerprint, in column fp. Buckets of up to
    ``bucket`` members are compared pair by pair. Members of larger ones, where
    pairs would grow with the square, meet exactly and in linear number: for a
    radius of 2, two fingerprints are linked if and only if some word lies within
    one bit of both, so each joins the least member around each of its 65 words.
    """
    if radius != 2:
        raise ValueError("exact links of crowded buckets are defined for a radius of 2")
    cells = _tables(distinct, "fp", radius)
    sizes = cells.groupBy("t", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialise(cells.join(sizes, ["t", "cell"]), "cells")
    small = met.filter(F.col("n") <= bucket)
    pairs = small.select("t", "cell", F.col("fp").alias("a")).join(small.select("t", "cell", F.col("fp").alias("b")), ["t", "cell"])
    pairs = pairs.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    crowded = met.filter(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    hubs = crowded.select("fp", F.explode(flips).alias("hub")).groupBy("hub").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)  # 65 members at most
    stars = hubs.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row for each input row: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links, null only where every id
    of the component is null. Repeated rows share a fingerprint and so a component.
    An empty table gives an empty result; further columns, whatever their names, are
    never read.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "prints")
    heads = materialise(prints.groupBy("fp").agg(F.min("key").alias("head")), "heads")
    roots = connected_components(links(heads.select("fp"), radius))
    placed = heads.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = placed.groupBy("root").agg(F.min("head").alias("component_id"))
    component = placed.select("fp", "root").join(firsts, "root").select("fp", "component_id")
    return prints.join(component, "fp").select(F.col("key").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_ODD = np.uint64(0x9E3779B97F4A7C15)  # any odd number


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-word shingles; of the whole sequence where it is shorter.

    A distinct word of the block is hashed once; a shingle's hash is a polynomial of its words' hashes.
    """
    codes, words, starts = split_words(texts, lower=True)
    hashes = np.array([xxhash.xxh64_intdigest(w, seed=SEED) for w in words.to_pylist()], np.uint64)[codes]

    def rolled(held: np.ndarray, size: int) -> np.ndarray:
        out = np.full(len(held) - size + 1, size, np.uint64)
        for i in range(size):
            out = out * _ODD + held[i : len(held) - size + 1 + i]
        return out

    whole = rolled(hashes, n) if len(hashes) >= n else hashes[:0]
    ends = zip(starts[:-1].tolist(), starts[1:].tolist())
    return [np.unique(whole[a : b - n + 1]) if b - a >= n else rolled(hashes[a:b], b - a)[:1] if b > a else hashes[:0] for a, b in ends]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()), n)[0]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of hashes; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


#: One row in SAMPLED tells which shingles are common; at most COMMON of them are sent to the tasks.
SAMPLED, COMMON = 10, 200_000
#: Bits of a set's parity bitmap, which goes with every candidate pair.
PARITY = 1024
#: Members of a list that one task compares with the whole list.
SALTED = 256
_PAIR = ["a", "b", "ka", "kb"]


def _batched(docs: DataFrame, id_col: str, text_col: str, run, schema: str, where: Column | None = None, only: DataFrame | None = None) -> DataFrame:
    """``run`` over blocks of rows (row, k, id, text); k is 64 bits of the row key. ``only``: row keys that count."""
    rows = docs.select(row_key(id_col, text_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows if only is None else with_keys(rows, "row", only)
    rows = rows.select("row", F.xxhash64("row").alias("k"), "id", "text")
    rows = rows if where is None else rows.filter(where)

    def mapped(batches):
        for batch in batches:
            yield from map(run, parts(batch, "text"))

    return map_arrow(rows, mapped, schema.format(id=rows.schema["id"].dataType.simpleString()))


def common_shingles(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several sampled rows hold, and how many do.

    They only set the order in which a set's shingles are taken; any order that all
    rows share finds the same pairs, so the sample bounds work, never results.
    """

    def run(part):
        found = shingle_sets(part.column("text"), shingle)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64), pa.int64())], names=["token"])

    tokens = _batched(docs, id_col, text_col, run, "token long", F.pmod("k", F.lit(SAMPLED)) == 0)
    counts = materialise(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "common")
    told = commonest(counts, COMMON).toPandas()  # at most COMMON rows
    hashes, n = told["token"].to_numpy(np.int64).view(np.uint64), told["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def prefix(found: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first len - ceil(similarity * len) + 1 of a sorted set's hashes, common ones last.

    Two sets of at least that Jaccard similarity share as many as ``similarity``
    times the larger's members, so their prefixes under one order meet.
    """
    size = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1 if len(found) else 0
    if not len(common):
        return found[:size]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    n = np.where(common[at] == found, counts[at], 0)
    return found[np.argsort(n, kind="stable")[:size]]


def _parity(found: np.ndarray, bits: int = PARITY) -> bytes:
    """Bit i is set where an odd number of the set's hashes fall on it."""
    odd = np.bincount((found >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _wide(found: np.ndarray) -> bytes | None:
    """A bitmap of as many bits as members, to the next power of two, for a set that PARITY bits say little of."""
    return _parity(found, 1 << (len(found) - 1).bit_length()) if len(found) > PARITY else None


def _differing(a: bytes, b: bytes) -> int:
    """Differing bits; the longer bitmap is folded to the shorter's size, which keeps parities."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, size)) ^ np.bitwise_xor.reduce(y.reshape(-1, size))).sum(dtype=np.int64))


def _most(na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """Members in which sets of these sizes and that similarity can differ."""
    return (na + nb) * (1 - similarity) / (1 + similarity) + 1e-6


def _marks(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """For each row: keys, id, size and digest of its shingle set, parity bitmap and prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, id_col, text_col, shingle))

    def run(part):
        sets = shingle_sets(part.column("text"), shingle)
        firsts = [prefix(x, similarity, *sent.value) for x in sets]
        ends = np.cumsum([0, *map(len, firsts)], dtype=np.int32)
        made = [
            pa.array([len(x) for x in sets], pa.int64()),
            pa.array([xxhash.xxh128_digest(x.tobytes(), seed=SEED) for x in sets], pa.binary()),
            pa.array([_parity(x) for x in sets], pa.binary()),
            pa.array([_wide(x) for x in sets], pa.binary()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts).view(np.int64), pa.int64())),
        ]
        return pa.RecordBatch.from_arrays([part.column("row"), part.column("k"), part.column("id"), *made], names=["row", "k", "id", "n", "digest", "parity", "wide", "prefix"])

    return _batched(docs, id_col, text_col, run, "row binary, k long, id {id}, n long, digest binary, parity binary, wide binary, prefix array<bigint>")


def _possible(similarity: float):
    """Pairs whose bitmaps differ in no more bits than sets of that similarity can differ in members."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, PARITY // 64) for c in ("pa", "pb"))
            most = _most(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), similarity)
            yield batch.select([*_PAIR, "na", "nb"]).filter(pa.array(np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= most))

    return run


def _still_possible(similarity: float):
    """The same with bitmaps that grow with the sets."""

    def run(batches):
        for batch in batches:
            most = _most(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), similarity)
            told = zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist())
            yield batch.select(_PAIR).filter(pa.array([_differing(a, b) <= m for (a, b), m in zip(told, most)], pa.bool_()))

    return run


def _similar(similarity: float):
    """Pairs whose sets (as sorted 64-bit hashes) have the similarity."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, "sa"):
                a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(c)] for c in ("sa", "sb"))
                yield part.select(_PAIR).filter(pa.array([jaccard(x, y) >= similarity for x, y in zip(a, b)], pa.bool_()))

    return run


def _verified(candidates: DataFrame, marks: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The candidates (ka, kb) whose whole texts are similar, with their row keys a, b.

    Bitmaps of a fixed size rule most pairs out, then bitmaps as long as the sets those
    of long texts; the set of a text that is left is made once, however many pairs hold it.
    """
    pair = "a binary, b binary, ka long, kb long"
    one = marks.select("k", "row", "n", "parity")
    close = candidates.join(one.toDF("ka", "a", "na", "pa"), "ka").join(one.toDF("kb", "b", "nb", "pb"), "kb")
    close = close.filter(F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-6)
    likely = materialise(map_arrow(close.select(*_PAIR, "na", "nb", "pa", "pb"), _possible(similarity), pair + ", na long, nb long"), "likely")
    long = F.least("na", "nb") > PARITY
    wide = marks.filter(F.col("n") > PARITY).select("row", "wide")
    held = likely.filter(long).join(wide.toDF("b", "wb"), "b").join(wide.toDF("a", "wa"), "a").select(*_PAIR, "na", "nb", "wa", "wb")
    left = materialise(likely.filter(~long).select(*_PAIR).unionByName(map_arrow(held, _still_possible(similarity), pair)), "left")
    wanted = materialise(left.select(F.col("a").alias("row")).union(left.select("b")).distinct(), "wanted")

    def run(part):
        sets = [x.tobytes() for x in shingle_sets(part.column("text"), shingle)]
        return pa.RecordBatch.from_arrays([part.column("row"), pa.array(sets, pa.binary())], names=["row", "set"])

    sets = _batched(docs, id_col, text_col, run, "row binary, set binary", only=wanted).dropDuplicates(["row"])
    sets = materialise(sets, "sets")
    met = left.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    return materialise(map_arrow(met.select(*_PAIR, "sa", "sb"), _similar(similarity), pair), "verified")


def fingerprint_pairs(docs: DataFrame, id_col: str, text_col: str, radius: int = 2) -> DataFrame:
    """Pairs (ka, kb) of row keys' 64 bits whose components are those of all fingerprints within ``radius`` bits.

    Fingerprints, covering tables and crowded buckets are those of ``near_duplicates``;
    rows of one fingerprint meet its least row.
    """
    prints = materialise(_mapped(docs, F.xxhash64(row_key(id_col, text_col)), text_col, [fingerprint], "fp").distinct(), "prints")
    heads = materialise(prints.groupBy("fp").agg(F.min("key").alias("head")), "heads")
    met = links(heads.select("fp"), radius).join(heads.toDF("a", "ka"), "a").join(heads.toDF("b", "kb"), "b").select("ka", "kb")
    equal = prints.join(heads, "fp").filter("key <> head").select(F.col("head").alias("ka"), F.col("key").alias("kb"))
    return materialise(met.unionByName(equal), "fingerprint-pairs")


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows (row, id, times listed) and verified edges (a, b) between row keys.

    The edges' components are those of all pairs whose shingle sets have an exact
    Jaccard similarity of at least ``similarity``. Equal sets are one node. Pairs whose
    SimHash fingerprints are close are compared first. Sets that similar share a
    shingle of their prefixes (rarest first), and so meet in a list. Where those edges
    don't connect them, each member is compared with the hub of each of its lists, the
    member that meets most others over all its lists (the original of edited copies, where
    there is one); then every pair of a list that the edges found so far do not connect,
    where the places of the shared shingle leave room for the similarity.
    """
    close = fingerprint_pairs(docs, id_col, text_col)
    marks = materialise(_marks(docs, id_col, text_col, shingle, similarity), "marks")
    heads = materialise(marks.groupBy("digest").agg(F.min("k").alias("head"), F.max("k").alias("tail")).filter("head < tail").select("digest", "head"), "heads")
    alike = materialise(marks.select("digest", "row", "k").join(broadcast_if_small(heads), "digest").select("digest", "row", "k", "head"), "alike")
    first = alike.filter("k = head").select("digest", F.col("row").alias("a")).distinct()
    equal = alike.filter("k <> head").select("digest", F.col("row").alias("b")).join(first, "digest").select("a", "b")
    nodes = marks.join(broadcast_if_small(materialise(alike.filter("k <> head").select("k").distinct(), "copies")), "k", "left_anti")

    postings = nodes.select("k", "n", F.posexplode("prefix").alias("at", "token"))
    tokens = postings.groupBy("token").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("held")).filter("first < last").select("token", "held")
    lists = materialise(postings.join(broadcast_if_small(materialise(tokens, "tokens")), "token").distinct(), "lists")
    marked = lists.select("k").union(close.select("ka")).union(close.select("kb")).distinct()
    marked = materialise(marks.select("k", "row", "n", "parity", "wide").join(broadcast_if_small(materialise(marked, "listed")), "k", "left_semi").dropDuplicates(["row"]), "marked")

    alike_prints = _verified(close, marked, docs, id_col, text_col, shingle, similarity)
    joined = broadcast_if_small(materialise(connected_components(alike_prints.select("ka", "kb")), "joined"))

    fame = lists.groupBy("k").agg(F.sum("held").alias("fame"))
    hubs = lists.select("token", "k").join(fame, "k").groupBy("token").agg(F.max(F.struct("fame", "k")).alias("best")).select("token", F.col("best.k").alias("ka"))
    stars = lists.select("token", F.col("k").alias("kb")).join(broadcast_if_small(materialise(hubs, "hubs")), "token").select("ka", "kb").filter("ka <> kb").distinct()
    stars = stars.join(joined.toDF("ka", "ra"), "ka", "left").join(joined.toDF("kb", "rb"), "kb", "left").filter("ra IS NULL OR rb IS NULL OR ra <> rb").select("ka", "kb")
    near = materialise(alike_prints.unionByName(_verified(stars, marked, docs, id_col, text_col, shingle, similarity)), "near")

    roots = connected_components(near.select("ka", "kb")).withColumnRenamed("node", "k")
    placed = lists.select("token", "k", "n", "at").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    placed = materialise(placed, "placed")
    apart = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("held")).filter("low < high")
    left = materialise(placed.join(broadcast_if_small(materialise(apart.select("token", F.ceil(F.col("held") / SALTED).alias("parts")), "apart")), "token"), "left")
    # A long list is dealt out: each part of it meets the whole list in a task of its own.
    some = left.select("token", F.pmod(F.xxhash64("k"), "parts").alias("part"), F.col("k").alias("ka"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("at").alias("ia"))
    whole = left.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("k").alias("kb"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    sized = F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-6
    # Where this is the first shingle that both share, no more follow than the shorter rest holds; a similar pair has such a shingle.
    enough = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= (F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-6
    pairs = some.join(whole, ["token", "part"]).filter((F.col("ra") != F.col("rb")) & (F.col("ka") < F.col("kb")) & sized & enough)
    far = _verified(pairs.select("ka", "kb").distinct(), marked, docs, id_col, text_col, shingle, similarity)
    return marks.groupBy("row").agg(F.min("id").alias("id"), F.count("*").alias("times")), equal.unionByName(near.select("a", "b")).unionByName(far.select("a", "b"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The input's rows and columns with one document of each group: the smallest id stays, nulls last.

    Of rows that repeat both id and text, null ids included, one stays.
    """
    rows, edges = similar_links(docs, id_col, text_col, shingle, similarity)
    placed = connected_components(edges).join(rows.select(F.col("row").alias("node"), "id"), "node")
    order = F.struct(F.col("id").isNull().alias("late"), F.col("id").alias("id"), F.col("node").alias("row"))
    firsts = placed.groupBy("root").agg(F.min(order).alias("first"))
    lost = materialise(placed.join(firsts, "root").filter("node <> first.row").select(F.col("node").alias("__q_row")), "lost")
    kept = without_keys(docs.withColumn("__q_row", row_key(id_col, text_col)), "__q_row", lost)
    again = materialise(rows.filter("times > 1").select(F.col("row").alias("__q_row")), "again")
    if not again.isEmpty():  # only repeated rows are shuffled with their texts
        kept = without_keys(kept, "__q_row", again).unionByName(with_keys(kept, "__q_row", again).dropDuplicates(["__q_row"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
