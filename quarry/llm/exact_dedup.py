"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one
space. Null and empty texts are equal. Of equal texts the row with the smallest id
stays; null ids come last. Rows that repeat both id and text are one document
listed twice: they are flagged alike, and ``drop_duplicates`` leaves one of them. An empty table gives an empty result, and
further columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import BROADCAST_ROWS, broadcast_if_small, materialise, text_or_empty, with_keys, without_keys

SPACES = r"[\x20\x09-\x0D]+"
PREFIX_CHARS = 256


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), SPACES, " ")


def _levels(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("body")).select(
        "id",
        "body",
        F.length("body").alias("len"),
        F.xxhash64(F.substring("body", 1, prefix_chars)).alias("head"),
    )


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Groups of two or more equal texts: ``sha`` (hex), ``keep_id``, ``group_size`` and
    ``most``, how often the group lists one id at most.

    Each level aggregates before it shuffles, so a text that fills a third of the
    table is one row for each task. The keys that survive length and prefix are
    written and counted: few are broadcast, and only rows that meet them are hashed
    in full; many are met by a shuffled join of narrow digests, never of texts.
    """
    rows = _levels(docs, id_col, text_col, prefix_chars)
    lengths = materialise(rows.groupBy("len").agg(F.count("*").alias("n")).filter("n > 1").select("len"), "lengths")
    heads = materialise(
        rows.select("len", "head").join(broadcast_if_small(lengths), "len", "left_semi").groupBy("len", "head").agg(F.count("*").alias("n")).filter("n > 1").select("len", "head"),
        "heads",
    )
    if heads.count() <= BROADCAST_ROWS:
        survivors = rows.join(F.broadcast(heads), ["len", "head"], "left_semi").select("id", "len", "head", F.sha2("body", 256).alias("sha"))
    else:
        survivors = rows.select("id", "len", "head", F.sha2("body", 256).alias("sha")).join(heads, ["len", "head"], "left_semi")
    return (
        survivors.groupBy("len", "head", "sha", "id")
        .agg(F.count("*").alias("n"))
        .groupBy("len", "head", "sha")
        .agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"), F.max("n").alias("most"))
        .filter("group_size > 1")
        .select("sha", "keep_id", "group_size", "most")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    groups = duplicate_groups(docs, id_col, text_col, prefix_chars)
    rows = docs.select(F.col(id_col), F.sha2(normalised(text_col), 256).alias("sha"))
    keep = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    return rows.join(groups, "sha", "left").select(
        id_col,
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col(id_col)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The input's rows and columns with one row of each group."""
    groups = duplicate_groups(docs, id_col, text_col, prefix_chars).select(F.col("sha").alias("__q_sha"), F.col("keep_id").alias("__q_keep"), F.col("most").alias("__q_most"))
    groups = materialise(groups, "groups")
    met = docs.withColumn("__q_sha", F.sha2(normalised(text_col), 256)).join(broadcast_if_small(groups.select("__q_sha", "__q_keep")), "__q_sha", "left")
    kept = met.filter(F.col("__q_keep").isNull() | F.col("__q_keep").eqNullSafe(F.col(id_col)))
    again = materialise(groups.filter("__q_most > 1 OR __q_keep IS NULL").select("__q_sha"), "again")
    if not again.isEmpty():  # only rows of groups that list an id twice are shuffled with their texts
        kept = without_keys(kept, "__q_sha", again).unionByName(with_keys(kept, "__q_sha", again).dropDuplicates(["__q_sha"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
