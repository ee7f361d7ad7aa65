"""What several corpus operators share: text forms, row keys, scratch tables, size checks."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when a count has shown that it has no more rows than this.
BROADCAST_ROWS = 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(module_name: str) -> None:
    """Send the module's functions to the workers by value: they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z alone become a-z; every other character stays."""
    return F.translate(text, _UPPER, _UPPER.lower())


def row_key(id_col: str, text_col: str) -> Column:
    """Sixteen bytes that name a row by its id and whole text; never null.

    Rows that repeat both share one key, and so get the same result.
    """
    named = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("null"))
    return F.unhex(F.md5(F.concat(named, F.lit("\0"), text_or_empty(text_col))))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local master only; a cluster
    without the setting is an error, since its machines share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    made = "file://" + tempfile.mkdtemp(prefix="quarry-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_dir(spark)}/quarry-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder, once its results are stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/quarry-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    It cuts lineage like checkpoint(), but computes the input once, compresses,
    and a lost executor costs no more than the tasks it ran.
    """
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(table: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a materialised table for broadcast if a count shows that it is small.

    A larger one is left to a shuffled join, whose hot keys adaptive execution splits.
    The bound is ``BROADCAST_ROWS`` as it stands at the call.
    """
    return F.broadcast(table) if table.count() <= (BROADCAST_ROWS if rows is None else rows) else table


#: Bits of a slice of a key filter (the fixed size of bitmap_construct_agg) and of the largest filter: 32 MB.
_SLICE, FILTER_BITS = 1 << 15, 1 << 28


def _place(key: Column) -> Column:
    return F.xxhash64(F.lit("place"), key)


def key_filter(keys: DataFrame) -> tuple[DataFrame, int]:
    """A bitmap of the materialised keys (one column): its slices and their number.

    It has 16 bits or more for each key up to ``FILTER_BITS`` in all, so its size is
    bounded whatever the number of keys. It knows every key; of others it takes a
    few for keys, and more as it fills up, so what it lets through is a superset.
    """
    n = keys.count()
    slices = 1 << max(0, (min(FILTER_BITS, 16 * n) // _SLICE - 1).bit_length())
    place = _place(F.col(keys.columns[0]))
    bits = keys.select(F.pmod(F.shiftright(place, 15), F.lit(slices)).cast("int").alias("slice"), place.bitwiseAND(F.lit(_SLICE - 1)).alias("bit"))
    return bits.groupBy("slice").agg(F.bitmap_construct_agg("bit").alias("bits")), slices


def may_hold(rows: DataFrame, key_col: str, told: tuple[DataFrame, int]) -> DataFrame:
    """The rows with a further column __q_may: false where the key filter rules ``key_col`` out."""
    table, slices = told
    place = _place(F.col(key_col))
    named = table.select(F.col("slice").alias("__q_slice"), F.col("bits").alias("__q_bits"))
    met = rows.withColumn("__q_slice", F.pmod(F.shiftright(place, 15), F.lit(slices)).cast("int")).join(F.broadcast(named), "__q_slice", "left")
    bit = place.bitwiseAND(F.lit(_SLICE - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__q_bits"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return met.withColumn("__q_may", F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7))) == 1, F.lit(False))).drop("__q_slice", "__q_bits")


def without_keys(rows: DataFrame, key_col: str, keys: DataFrame) -> DataFrame:
    """The rows whose key isn't among the materialised ``keys`` (one column, named as ``key_col``).

    Few keys are broadcast. Beyond that only rows that a key filter doesn't clear
    are shuffled to meet the keys, so that whole texts stay where they are.
    """
    if keys.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), key_col, "left_anti")
    marked = may_hold(rows, key_col, key_filter(keys))
    return marked.filter(~F.col("__q_may")).unionByName(marked.filter("__q_may").join(keys, key_col, "left_anti")).drop("__q_may")


def with_keys(rows: DataFrame, key_col: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is among the materialised ``keys`` (one column, named as ``key_col``).

    Beyond the broadcast bound only rows that a key filter lets through are shuffled.
    """
    if keys.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), key_col, "left_semi")
    return may_hold(rows, key_col, key_filter(keys)).filter("__q_may").drop("__q_may").join(keys, key_col, "left_semi")


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The rows of highest ``n`` (a count) of a materialised table, at most ``most``.

    Found through a histogram of about 1,000 cells at most, so nothing is sorted in one
    task; rows of one cell, whose counts differ by a twentieth at most, stay or go together.
    """
    cell = F.floor(F.log2(F.col("n").cast("double")) * 16)
    held, least = 0, None
    for r in sorted(counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["cell"]):
        if (held := held + r["rows"]) > most:
            break
        least = r["cell"]
    return counts.filter(cell >= least) if least is not None else counts.limit(0)
