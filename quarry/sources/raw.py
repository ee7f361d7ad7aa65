"""Raw sources and sinks: contracts, adapters, tolerant readers, exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RAW = ["source", "source_id", "source_split", "text_raw", "lang_source", "license", "country", "model_family", "created_ts", "native_category", "nsfw_hint", "meta_json"]


def require_columns(df: DataFrame, needed: list[str], source: str) -> DataFrame:
    """O-S6: an error that names what a source lacks."""
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"{source} lacks {', '.join(missing)}")
    return df


def raw_rows(df: DataFrame, source: str, license: str, **columns: Column) -> DataFrame:
    """O-S4, O-S5: the twelve raw columns without nulls or blank texts, stamped with the source's licence."""
    if unknown := set(columns) - set(RAW):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    given = {c: F.coalesce(columns[c], F.lit(False if c == "nsfw_hint" else "")) if c in columns else F.lit(False if c == "nsfw_hint" else "") for c in RAW}
    given |= {"source": F.lit(source), "license": F.lit(license)}
    return df.select(*[given[c].alias(c) for c in RAW]).filter(F.btrim("text_raw", F.lit(" \t\n\r\x0b\x0c")) != "")


def first_turn(turns: DataFrame, role: str = "user") -> DataFrame:
    """O-S13, O-S14: each conversation's first turn of a role, where it has text."""
    own = turns.filter(F.col("role") == role).groupBy("conv_id").agg(F.min_by(F.struct("turn", "text"), "turn").alias("f"))
    return own.select("conv_id", "f.turn", "f.text").filter("text IS NOT NULL AND text <> ''")


def transcript(turns: DataFrame) -> DataFrame:
    """conv_id, body: turns as Human and Assistant paragraphs, in order."""
    who = F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "Assistant").otherwise("System")
    lines = turns.select("conv_id", "turn", F.concat(F.lit("\n\n"), who, F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "").alias("body"))


def first_human_turn(body: Column) -> Column:
    """O-S11: what stands between the first Human mark and the next mark."""
    after = F.get(F.split(body, r"\n\nHuman: ", 2), 1)
    return F.trim(F.get(F.split(after, r"\n\n(Human|Assistant): ", 2), 0))


def content_text(parts: Column) -> Column:
    """O-S14: text of a list of parts (type, text), joined by line ends."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")


def union_first_wins(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """O-S10, O-S12, O-S16: parts in order; a key that an earlier part has is left out."""
    whole = None
    for i, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(i))
        whole = part if whole is None else whole.unionByName(part)
    place = F.row_number().over(W.partitionBy(key).orderBy("_part", order))
    return whole.withColumn("_place", place).filter("_place = 1").drop("_place", "_part")


def with_context(instruction: Column, context: Column) -> Column:
    """O-S9."""
    return F.when(F.trim(F.coalesce(context, F.lit(""))) != "", F.concat_ws("\n\n", instruction, context)).otherwise(instruction)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """O-S25: parsed objects, and the lines that are none: fences, prose and blanks are passed over."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim(F.col("value")), "^﻿", "").alias("line")).filter("line <> '' AND NOT startswith(line, '```')")
    parsed = lines.select("line", F.from_json("line", schema).alias("o"))
    is_object = F.startswith("line", F.lit("{")) & F.col("o").isNotNull()
    return parsed.filter(is_object).select("o.*"), parsed.filter(~is_object).select("line")


def write_jsonl(df: DataFrame, path: str) -> None:
    """O-S21: fixed key order, nulls kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """O-S22: every field quoted, quotes doubled; booleans true or false, null empty."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """O-S20: the writer's commit makes the result appear at once."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


# O-S18: a gated source is declared and disabled.
DISABLED_SOURCES = {"lmsys-chat-1m": "gated: needs an accepted licence and a token"}


def resolve_sources(names: list[str] | None, known: list[str]) -> list[str]:
    """O-S19: hyphens and underscores are alike, an unknown or disabled name is an error, none means all."""
    plain = {k.replace("-", "_"): k for k in known}
    if not names:
        return [k for k in known if k not in DISABLED_SOURCES]
    for n in names:
        if n in DISABLED_SOURCES:
            raise ValueError(f"{n} is disabled: {DISABLED_SOURCES[n]}")
        if n.replace("-", "_") not in plain:
            raise ValueError(f"unknown source {n}; known: {', '.join(known)}")
    return [plain[n.replace("-", "_")] for n in names]


#: A raw table's name in a path: a file, or a folder of part files that may lie under key=value folders.
_STEM = r"([^/]+)\.parquet(?:/[^/=]+=[^/]*)*(?:/[^/]*)?$"


def scan_raw(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """O-S2: the rows of every raw table but the pools, with the table's stem as source_file.

    A table is a file or a folder of part files, as Spark writes it; ``pattern`` names
    tables, not part files. Pools are left out by name, which Spark prunes before it
    opens a file.
    """
    plain = re.sub(r"([\\\[\]{}*?])", r"\\\1", folder.rstrip("/"))
    rows = spark.read.parquet(f"{plain}/{pattern}")
    rows = rows.filter(~F.endswith(F.regexp_extract("_metadata.file_path", _STEM, 1), F.lit("_pool")))
    return rows.withColumn("source_file", F.regexp_extract("_metadata.file_path", _STEM, 1))


def iso_text(stamp: Column) -> Column:
    """O-S7: ISO text of a timestamp, fractions of a second only where there are any; null gives an empty text."""
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(stamp, "SSSSSS")
    return F.when(stamp.isNull(), "").when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def compact_meta(meta: Column) -> Column:
    """O-S7: compact JSON of a map, nulls kept; null and empty maps give {}."""
    return F.when(meta.isNull() | (F.size(meta) == 0), "{}").otherwise(F.to_json(meta, {"ignoreNullFields": "false"}))
