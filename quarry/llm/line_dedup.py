"""Corpus-wide line dedup: hash normalised lines, count documents, drop frequent lines.

A text splits at ``\\n``; null and empty texts are one empty line. A line's key is
the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at
least ``min_chars`` code points that at least ``min_docs`` documents hold lose all
their lines; the others keep their order. Each row is a document, so a repeated
row counts again; with ``by_id`` distinct ids that are not null count. Keys meet as two 64-bit hashes of different seeds. An empty
table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import ascii_lower, broadcast_if_small, materialise, row_key, text_or_empty

EDGE = " \t\n\x0b\x0c\r"


def _keys(text_col: str) -> Column:
    """The key of each line of a text, in order."""
    lines = F.split(ascii_lower(text_or_empty(text_col)), "\n")
    return F.transform(lines, lambda line: F.btrim(line, F.lit(EDGE)))


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second seed"), key).alias("h2")]


def frequent_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, by_id: str | None = None) -> DataFrame:
    """Hashes (h1, h2) of keys in at least ``min_docs`` documents, with their ``n_docs``.

    A key that a document repeats is dropped before the shuffle, and counts are
    summed in each task first: a line that every document holds is one row a task.
    ``by_id`` names the id column whose distinct values count in place of rows; only
    rows of repeated ids are counted by (hash, id), made distinct in each task first.
    """

    def hashed(rows: DataFrame, *more: Column) -> DataFrame:
        keys = rows.select(*more, F.explode(F.array_distinct(_keys(text_col))).alias("key")).filter(F.length("key") >= min_chars)
        return keys.select(*[m for m in ("id",) if more], *_hashed(F.col("key")))

    held = hashed(docs)
    if by_id is not None:
        named = docs.filter(F.col(by_id).isNotNull())
        again = materialise(named.groupBy(F.col(by_id).alias(by_id)).agg(F.count("*").alias("n")).filter("n > 1").select(by_id), "again")
        held = hashed(named)
        if not again.isEmpty():
            again = broadcast_if_small(again)
            pairs = hashed(named.join(again, by_id, "left_semi"), F.col(by_id).alias("id")).distinct()
            held = hashed(named.join(again, by_id, "left_anti")).unionByName(pairs.select("h1", "h2"))
    return held.groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def _dropped_positions(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int, by_id: bool) -> DataFrame:
    """For each row key that loses lines, their positions."""
    frequent = broadcast_if_small(materialise(frequent_lines(docs, text_col, min_docs, min_chars, id_col if by_id else None).select("h1", "h2"), "lines"))
    # The row's key is made below the explode: beside it, it would be made again for each line.
    lines = docs.select(row_key(id_col, text_col).alias("row"), _keys(text_col).alias("all"))
    lines = lines.select("row", F.posexplode("all").alias("pos", "key")).filter(F.length("key") >= min_chars)
    return lines.select("row", "pos", *_hashed(F.col("key"))).join(frequent, ["h1", "h2"], "left_semi").groupBy("row").agg(F.collect_set("pos").alias("lost"))


def _reassembled(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int, by_id: bool) -> DataFrame:
    """The input with its lines, the positions lost and the text that stays."""
    lost = _dropped_positions(docs, id_col, text_col, min_docs, min_chars, by_id).withColumnRenamed("row", "__q_row").withColumnRenamed("lost", "__q_lost")
    met = docs.withColumn("__q_row", row_key(id_col, text_col)).join(lost, "__q_row", "left")
    met = met.withColumn("__q_lines", F.split(text_or_empty(text_col), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__q_lines") - 1), F.col("__q_lost"))
    kept = F.array_join(F.transform(stay, lambda p: F.get("__q_lines", p)), "\n")
    return met.withColumn("__q_kept", F.when(F.col("__q_lost").isNull(), text_or_empty(text_col)).otherwise(kept))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, by_id: bool = False) -> DataFrame:
    """One row for each input row: id, n_lines before dropping, n_dropped, kept_text."""
    return _reassembled(docs, id_col, text_col, min_docs, min_chars, by_id).select(
        id_col,
        F.size("__q_lines").cast("long").alias("n_lines"),
        F.when(F.col("__q_lost").isNull(), 0).otherwise(F.size("__q_lost")).cast("long").alias("n_dropped"),
        F.col("__q_kept").alias("kept_text"),
    )
