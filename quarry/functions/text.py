"""Text columns: identifiers, normal forms, sizes, markers. Built-in functions unless said otherwise."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.vocabulary import FAMILIES

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

SPACE = r"[\x20\x09-\x0D]+"
_ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"


def stable_id(source: Column, source_id: Column, raw: Column) -> Column:
    """O-T1: sixteen hex digits of SHA-256 over source and id, or over source and text where there is no id."""
    with_id = F.concat_ws(":", source, source_id)
    with_text = F.concat(source, F.lit(":text:"), raw)
    return F.substring(F.sha2(F.when(F.coalesce(source_id, F.lit("")) != "", with_id).otherwise(with_text), 256), 1, 16)


def norm_display(text: Column) -> Column:
    """O-T2: one kind of line end, no zero-width or control characters, two newlines at most, no outer space."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[​‌‍⁠﻿]", "")
    text = F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+\z", "")


def norm_for_hash(text: str) -> str:
    """O-T3 on one string: NFKC, casefold, no combining marks, one space, no closing full stops."""
    folded = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold())
    bare = " ".join("".join(c for c in folded if not unicodedata.combining(c)).split())
    return re.sub(r"[.!?…]+\Z", "", bare).rstrip()


@F.pandas_udf(T.StringType())
def comparison_key(text: pd.Series) -> pd.Series:
    """O-T3, exact over all of Unicode; normal forms are not built in, so an Arrow batch at a time."""
    return text.map(lambda t: None if t is None else norm_for_hash(t))


def comparison_key_latin(text: Column) -> Column:
    """O-T3 within the engine, for text in the Latin alphabets of western Europe."""
    bare = F.replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), F.lit("ß"), F.lit("ss"))
    one = F.trim(F.regexp_replace(bare, SPACE, " "))
    return F.rtrim(F.regexp_replace(one, r"[.!?…]+\z", ""))


def hash_norm(key: Column) -> Column:
    """O-T4."""
    return F.sha2(key, 256)


def n_words(text: Column) -> Column:
    """O-T5: words between white space; n_chars is F.length."""
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")


def token_set(key: Column) -> Column:
    """O-T6: distinct words of a comparison key; an empty key has none."""
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(key, " ")))


def null_if_empty(text: Column) -> Column:
    """O-T7."""
    return F.nullif(text, F.lit(""))


def meta_fold(meta: Column, hint: Column) -> Column:
    """O-T8: JSON leftovers, wrapped as _raw_meta if they are no object, with nsfw_hint only where true."""
    parsed = F.from_json(meta, "map<string,string>")
    given = F.when(F.coalesce(meta, F.lit("")) == "", F.create_map().cast("map<string,string>")).when(parsed.isNotNull(), parsed).otherwise(F.create_map(F.lit("_raw_meta"), meta))
    extra = F.when(hint, F.create_map(F.lit("nsfw_hint"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(given, extra))


def truncate_marked(text: Column, limit: int) -> Column:
    """O-T9."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(" …[TRUNCADO]"))).otherwise(text)


def preview(text: Column, cut: int = 400) -> tuple[Column, Column]:
    """O-T10: the cut text and whether it was cut."""
    return F.substring(text, 1, cut), F.length(text) > cut


def has_chat_markers(text: Column) -> Column:
    """O-T11: a pasted conversation's markers in the first 20,000 characters, in either case."""
    head = F.lower(F.substring(text, 1, 20_000))
    return F.contains(head, F.lit("user:")) | F.contains(head, F.lit("assistant:"))


def safe_filename(name: Column) -> Column:
    """O-T12."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+\z", ""), 1, 80)


def country_key(country: Column) -> Column:
    """O-T13: upper case without accents, one space."""
    return F.trim(F.regexp_replace(F.upper(F.translate(F.lower(F.coalesce(country, F.lit(""))), _ACCENTED, _PLAIN)), SPACE, " "))


def model_family(model: Column) -> Column:
    """O-T14: the first family whose prefix fits, else the name itself."""
    model, found = F.coalesce(model, F.lit("")), None
    for prefix, family in FAMILIES:
        found = (F if found is None else found).when(model.startswith(prefix), family)
    return found.otherwise(model)


def len_bucket(chars: Column) -> Column:
    """O-T15: an upper edge of 600 belongs to the middle."""
    return F.when(chars < 120, "1_lt120").when(chars <= 600, "2_120a600").otherwise("3_gt600")


def size_band(chars: Column, edges: list[int]) -> Column:
    """O-T16: half-open bands named after their edges."""
    found = F.when(chars < edges[0], f"lt{edges[0]}")
    for low, high in zip(edges, edges[1:]):
        found = found.when(chars < high, f"{low}a{high}")
    return found.otherwise(f"ge{edges[-1]}")


def year_of(created: Column) -> Column:
    """O-T17."""
    return F.when(F.substring(created, 1, 4).rlike(r"^\d{4}$"), F.substring(created, 1, 4)).otherwise("????")


def strata_key(model: Column, chars: Column, created: Column) -> Column:
    """O-T18."""
    return F.concat_ws("|", model_family(model), len_bucket(chars), year_of(created))


def file_metadata(name: Column, collections: dict[str, str], subjects: dict[str, str]) -> Column:
    """O-T19: struct of collection, subject and grade told by a file name; empty where it tells none."""
    stem = F.regexp_replace(F.upper(F.translate(F.lower(F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*\z", "")), _ACCENTED, _PLAIN)), r"[^A-Z0-9]+", "_")
    collection = F.coalesce(*[F.when(F.contains(stem, F.lit(k)), v) for k, v in collections.items()], F.lit(""))
    subject = F.coalesce(*[F.when(stem.rlike(f"(^|_){re.escape(k)}(_|$)"), subjects[k]) for k in sorted(subjects, key=len, reverse=True)], F.lit(""))
    return F.struct(collection.alias("collection"), subject.alias("subject"), F.regexp_extract(stem, r"(?:^|_)(?:VOL_?)?([123])(?:_|$)", 1).alias("grade"))


# Literals that betray a dirty excerpt.
DIRTY_MARKERS = ["Resposta:", "Espera-se que", "Respostas e comentários", "Gabarito", "Todos os direitos", "/Shutterstock", "Acesso em:", "apud", "•", "ﬁ "]
HYPHENS_PER_THOUSAND = 6.0


def dirty_warnings(text: Column) -> Column:
    """O-T20: the markers a text holds, and 'hyphenation' where broken words are dense."""
    density = F.regexp_count(text, F.lit("[a-zà-ÿ]-\n[a-zà-ÿ]")) * 1000 / F.length(text)
    found = [F.when(F.contains(text, F.lit(m)), m) for m in DIRTY_MARKERS]
    return F.array_compact(F.array(*found, F.when(density >= HYPHENS_PER_THOUSAND, "hyphenation")))


def valid_skills(codes: Column) -> Column:
    """O-T21: well-formed skill codes, each once, in order."""
    return F.array_distinct(F.filter(F.transform(codes, lambda c: F.upper(F.trim(c))), lambda c: c.rlike(r"^EM13[A-Z]{2,3}\d{2,3}$")))


def common_run(a: str, b: str) -> str:
    """O-T22 on two strings: their longest common run of characters, case folded, one space.

    Whether a run of some length is shared is monotone, so its length is bisected.
    """
    a, b = (re.sub(r"\s+", " ", x.casefold()) for x in (a or "", b or ""))

    def shared(size: int) -> int | None:
        held = {a[i : i + size] for i in range(len(a) - size + 1)}
        return next((j for j in range(len(b) - size + 1) if b[j : j + size] in held), None)

    low, high, at = 0, min(len(a), len(b)), 0
    while low < high:
        middle = (low + high + 1) // 2
        if (j := shared(middle)) is None:
            high = middle - 1
        else:
            low, at = middle, j
    return b[at : at + low]


@F.pandas_udf(T.StringType())
def longest_common_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """O-T22; searching for shared runs has no built-in form."""
    return pd.Series([common_run(x, y) for x, y in zip(a, b)])


def natural_key(file: Column, excerpt: Column) -> Column:
    """O-T23: SHA-256 of file and comparison key, or of the excerpt where its key is empty."""
    key = comparison_key_latin(excerpt)
    return F.sha2(F.concat(file, F.lit("\0"), F.when(key == "", excerpt).otherwise(key)), 256)


def verbatim(excerpt: Column, *whole: Column) -> Column:
    """O-T24: the excerpt stands as it is in every one of the texts."""
    found = F.lit(True)
    for text in whole:
        found = found & F.contains(text, excerpt)
    return found


def md_cell(text: Column) -> Column:
    """O-T25."""
    return F.trim(F.regexp_replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), SPACE, " "))
