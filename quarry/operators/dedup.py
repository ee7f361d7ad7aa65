"""Duplicate groups over a curated corpus: canonical choice, maps and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.operators import cosine
from quarry.sources.scratch import kept

UNKNOWN_SOURCE = 1 << 20


def canonical_order(license_rank: Column, source_rank: Column, source_id: Column, uid: Column) -> Column:
    """O-D3, O-D4: the struct whose least value is the canonical row: licence, source, a known id, id, uid."""
    return F.struct(
        F.coalesce(license_rank, F.lit(9)).alias("license_rank"),
        F.coalesce(source_rank, F.lit(UNKNOWN_SOURCE)).alias("source_rank"),
        source_id.isNull().alias("no_id"),
        source_id.alias("source_id"),
        uid.alias("uid"),
    )


def first_by_uid(rows: DataFrame, uid: str, *order: str) -> DataFrame:
    """O-D1: of rows with one uid, the first in reading order."""
    place = F.row_number().over(W.partitionBy(uid).orderBy(*order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def exact_groups(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """O-D2, O-D5: key, the canonical row's order struct, group size and its sorted sources.

    Rows with an empty key never group. Aggregated in each task before the shuffle,
    so a key that many rows share is one row for each task.
    """
    return (
        rows.filter(F.col(key) != "")
        .groupBy(key)
        .agg(F.min(order).alias("canonical"), F.count("*").alias("group_size"), F.array_sort(F.collect_set("source")).alias("sources"))
        .filter("group_size > 1")
    )


def exact_dedup(rows: DataFrame, key: str, order: Column, uid: str = "uid") -> DataFrame:
    """Every row with kept, canonical_uid, n_exact_dups (of the canonical row, else 0) and dup_sources."""
    groups = exact_groups(rows, key, order)
    met = rows.join(groups, key, "left")
    kept = F.col("canonical").isNull() | (F.col("canonical.uid") == F.col(uid))
    return met.select(
        *rows.columns,
        kept.alias("kept"),
        F.coalesce("canonical.uid", F.col(uid)).alias("canonical_uid"),
        F.when(kept & F.col("group_size").isNotNull(), F.col("group_size") - 1).otherwise(0).cast("long").alias("n_exact_dups"),
        F.when(kept, F.array_except("sources", F.array("source"))).alias("dup_sources"),
    )


def duplicate_map(deduped: DataFrame, uid: str = "uid") -> DataFrame:
    """O-D6: one row for each discard."""
    return deduped.filter(~F.col("kept")).select(F.col(uid), "canonical_uid", "source")


def length_ratio(a: Column, b: Column) -> Column:
    """O-D10: at least 1; 1 for two zeros, infinite for one."""
    return F.when((a == 0) & (b == 0), F.lit(1.0)).when(F.least(a, b) == 0, F.lit(float("inf"))).otherwise(F.greatest(a, b) / F.least(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """O-D9: of two sets; two empty sets are alike, one empty set is like nothing."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_pairs(vectors: DataFrame, at_least: float, id_col: str = "vec_id", vec_col: str = "embedding", part_col: str = "label", blocks: int | None = None) -> DataFrame:
    """O-D8: part, a, b, cosine: every pair a < b within a partition whose cosine is at least ``at_least``.

    Exact, and so quadratic in a partition by nature. Each partition is cut into blocks
    by id (``blocks`` of them, or as many as its size asks for); a pair of blocks is one
    unit of work, multiplied as matrices, so no task holds a partition whole.
    """
    rows = vectors.select(id_col, vec_col, part_col)
    kind, part = rows.schema[id_col].dataType.simpleString(), rows.schema[part_col].dataType.simpleString()
    return cosine.map_cells(cosine.cells(rows, id_col, vec_col, part_col, blocks), cosine.pairs_of(at_least), f"part {part}, a {kind}, b {kind}, cosine double")


def cosine_links(
    vectors: DataFrame, at_least: float, least_jaccard: float | None = None, most_ratio: float = 2.0, id_col: str = "vec_id", vec_col: str = "embedding", part_col: str = "label", blocks: int | None = None
) -> DataFrame:
    """O-D11: edges (a, b) whose components are those of all pairs that ``cosine_pairs`` gives.

    With ``least_jaccard`` the pairs are those that columns tokens and n_chars confirm too
    (tokens by 64-bit hashes); rows without a text have no pair. An edge needn't be a pair:
    each unit of work gives a star for each of its components, so a group of m rows gives
    about m edges for each block, where its pairs grow with the square.
    """
    rows = vectors.select(id_col, vec_col, part_col)
    if least_jaccard is not None:
        hashed = F.array_distinct(F.transform("tokens", lambda x: F.xxhash64(x)))
        rows = vectors.filter("tokens IS NOT NULL AND n_chars IS NOT NULL").select(id_col, vec_col, part_col, hashed.alias("tokens"), "n_chars")
    kind = rows.schema[id_col].dataType.simpleString()
    return cosine.map_cells(cosine.cells(rows, id_col, vec_col, part_col, blocks), cosine.links_of(at_least, least_jaccard, most_ratio), f"a {kind}, b {kind}")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """O-D12: node, root for nodes of edges (a, b): the least node reachable, of any ordered type.

    Least labels travel along the edges and then along themselves (a label's own
    label), until nothing changes. The edges and each round's labels are written to the
    shared folder, so each is computed once. Labels that still change after ``rounds``
    rounds are an error, never a result.
    """
    edges = kept(edges.select("a", "b"))
    both = kept(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    labels, total = kept(labels), None
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        moved = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        labels = kept(moved.join(jump, "root", "left").select("node", F.coalesce("further", "root").alias("root")))
        now = labels.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == total:
            return labels
        total = now
    raise RuntimeError(f"components still change after {rounds} rounds")


def alike(cosine: Column, a: Column, b: Column, least_cosine: float, least_jaccard: float, most_ratio: float) -> Column:
    """O-D11: close vectors, and token sets and lengths that confirm it. ``a``, ``b`` hold tokens, n_chars."""
    return (cosine >= least_cosine) & (jaccard(a["tokens"], b["tokens"]) >= least_jaccard) & (length_ratio(a["n_chars"], b["n_chars"]) <= most_ratio)


def confirm_pairs(pairs: DataFrame, texts: DataFrame, least_jaccard: float = 0.65, most_ratio: float = 2.0) -> DataFrame:
    """O-D11: the pairs (a, b, cosine) that texts (node, tokens, n_chars) confirm; nodes without a text have no pair."""
    held = texts.select("node", F.struct("tokens", "n_chars").alias("held"))
    met = pairs.join(held.toDF("a", "__q_a"), "a").join(held.toDF("b", "__q_b"), "b")
    return met.filter(alike(F.lit(1.0), F.col("__q_a"), F.col("__q_b"), 0.0, least_jaccard, most_ratio)).select(*pairs.columns)


def near_dedup(pairs: DataFrame, canonical: DataFrame, vectors: DataFrame, at_least: float, pairwise: bool = True, least_jaccard: float = 0.65, most_ratio: float = 2.0) -> DataFrame:
    """O-D13 to O-D15: node, canonical node, clear, removed, n_near_dups.

    ``clear`` tells whether a member meets the canonical one's thresholds itself. Without
    ``pairwise`` every member of a component but its canonical one goes; with it, a member
    that isn't clear stays. n_near_dups counts, on the canonical row, those that went.
    ``canonical`` has node and its order; ``vectors`` has node, v and, where texts count
    too, tokens and n_chars. ``pairs`` may be any edges with the components of the pairs.
    """
    found = components(pairs).join(canonical, "node")
    best = found.groupBy("root").agg(F.min_by("node", "order").alias("canonical"))
    texts = "tokens" in vectors.columns
    held = vectors.select("node", F.struct(*[c for c in vectors.columns if c != "node"]).alias("mine"))
    met = found.select("root", "node").join(best, "root").join(held, "node").join(held.toDF("canonical", "theirs"), "canonical")
    a, b = F.col("mine"), F.col("theirs")
    angle = dot(a["v"], b["v"]) / F.greatest(norm(a["v"]) * norm(b["v"]), F.lit(1e-12))
    clear = alike(angle, a, b, at_least, least_jaccard, most_ratio) if texts else angle >= at_least
    told = met.select("node", "canonical", clear.alias("clear"))
    told = told.withColumn("removed", (F.col("node") != F.col("canonical")) & (F.col("clear") if pairwise else F.lit(True)))
    went = told.filter("removed").groupBy(F.col("canonical").alias("node")).agg(F.count("*").alias("n_near_dups"))
    return told.join(went, "node", "left").withColumn("n_near_dups", F.coalesce("n_near_dups", F.lit(0)))
