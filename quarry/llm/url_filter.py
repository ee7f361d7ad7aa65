"""URL filters by a temporal list join.

A list is a table of dated entries: ``kind`` (``domain``: the host itself or any
host below it; ``prefix``: URLs whose host and path begin with the pattern at a
path boundary), ``pattern``, ``action`` (``add`` or ``remove``), ``at`` and
``category``. Entries of one kind and pattern become validity intervals: each lasts
until the next one, the last for ever; of several at one moment the removal wins.
A capture is compared with the entry in force at its fetch time: the latest one
at or before it. It is blocked if any of its patterns is then on the list.

Scheme, user, port, query and fragment don't matter; hosts and paths compare with
A-Z lower-cased, hosts without a final dot. Null or unparsable URLs and null fetch times match nothing.
Entries with a null in kind, pattern, action or time are left out. Repeated rows
get the same result, an empty table an empty one; further columns are not looked
at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.llm.shared import ascii_lower, broadcast_if_small, materialise


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, or an empty string."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def path_of(url: Column) -> Column:
    """Path of an absolute URL without its first slash, query and fragment."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """kind, pattern, category, valid_from, valid_to (null: open) of the periods on the list."""
    whole = entries.select("kind", "pattern", "action", "at", "category").filter("kind IS NOT NULL AND pattern IS NOT NULL AND action IS NOT NULL AND at IS NOT NULL")
    moments = whole.groupBy("kind", ascii_lower(F.col("pattern")).alias("pattern"), F.col("at").alias("valid_from")).agg(F.max("action").alias("action"), F.min("category").alias("category"))
    own = W.partitionBy("kind", "pattern").orderBy("valid_from")  # one pattern's history
    return moments.withColumn("valid_to", F.lead("valid_from").over(own)).filter("action = 'add'").select("kind", "pattern", "category", "valid_from", "valid_to")


def _patterns(host: Column, path: Column) -> Column:
    """Every (kind, pattern) that would match a URL: the host's suffixes, and host with each leading path."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    parts = F.split(ascii_lower(path), "/")
    leading = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("pattern")))
    return F.array_distinct(F.concat(suffixes, leading))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row for each input row: id, host, fetch time, blocked, n_entries (in force), categories (sorted, comma-joined).

    Distinct (url, time) pairs are looked up, as narrow rows: a pattern's intervals
    are broadcast if a count shows them to be few, else met by a shuffled join
    whose hot hosts adaptive execution splits.
    """
    known = broadcast_if_small(materialise(intervals(entries), "intervals"))
    host = F.regexp_replace(host_of(F.col(url_col)), r"\.$", "")
    rows = captures.select(F.col(id_col), F.col(url_col).alias("url"), F.col(time_col).alias("at"), host.alias("host"), path_of(F.col(url_col)).alias("path"))
    key = F.sha2(F.concat_ws("\0", "host", "path", F.col("at").cast("string")), 256)
    rows = rows.withColumn("capture", key)
    asked = rows.filter("host <> '' AND at IS NOT NULL").groupBy("capture").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("at").alias("at"))
    asked = asked.select("capture", "at", F.explode(_patterns(F.col("host"), F.col("path"))).alias("p")).select("capture", "at", "p.kind", "p.pattern")
    met = asked.join(known, ["kind", "pattern"]).filter("at >= valid_from AND (valid_to IS NULL OR at < valid_to)")
    told = met.groupBy("capture").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return rows.join(told, "capture", "left").select(
        id_col, "host", F.col("at").alias(time_col), F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0).cast("long")).alias("n_entries"), F.coalesce("categories", F.lit("")).alias("categories")
    )
