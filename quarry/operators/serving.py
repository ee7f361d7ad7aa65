"""The serving table, text vectors and reports that are written beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBED_CHARS = 3_000


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """O-V1, O-S24: a unit vector by the hashing trick over the words of the first 3,000 characters.

    It stands in for a sentence model, which the engine doesn't ship.
    """
    words = F.filter(F.split(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, EMBED_CHARS)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dims)).cast("int"))

    def vector(held: Column) -> Column:
        signed = lambda i: F.size(F.filter(held, lambda p: p == 2 * i)) - F.size(F.filter(held, lambda p: p == 2 * i + 1))
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: signed(i).cast("double"))

    # As variables of a lambda the words and the vector are made once a row.
    raw = F.get(F.transform(F.array(places), vector), 0)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.get(F.transform(F.array(F.struct(raw.alias("v"))), lambda r: F.transform(r["v"], lambda x: x / F.greatest(length(r["v"]), F.lit(1e-12)))), 0)


def build_id(rows: DataFrame, key: str = "uid") -> DataFrame:
    """One row, build_id: 16 hex digits that follow from the set of keys alone, in any order."""
    one = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).alias("s"))
    return one.select(F.substring(F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")), 256), 1, 16).alias("build_id"))


def load_table(rows: DataFrame, path: str, partition: str = "lang") -> None:
    """O-S23: the table, one folder for each value of ``partition``; readers see the old or the new one."""
    rows.repartition(F.col(partition), F.pmod(F.xxhash64("id"), F.lit(64))).write.mode("overwrite").partitionBy(partition).option("compression", "zstd").parquet(path)


def dataset_card(rows: DataFrame) -> DataFrame:
    """O-W31: section, name, n of a card, rendered by whoever reads it."""
    parts = [rows.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(c).alias("section"), "name", "n") for c in ("lang", "license")]
    quality = rows.filter("quality IS NOT NULL").groupBy(F.col("quality").cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit("quality").alias("section"), "name", "n")
    return parts[0].unionByName(parts[1]).unionByName(quality)
