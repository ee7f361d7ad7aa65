"""The curation service: filters, facets, full-text and vector search, collections, export."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.vocabulary import DOMAINS, LICENSES, TASK_TYPES
from quarry.operators.dedup import dot, norm
from quarry.sources.scratch import scratch_dir


@dataclass(frozen=True)
class Filters:
    """O-F1 to O-F11. Every field but ``q``, ``hits`` and ``members`` names a column or a range of one.

    ``q`` is a full-text query over the column text; ``hits`` are the ids that it met, where they are known already.
    """

    lang: list[str] | None = None
    lang_variant: list[str] | None = None
    source: list[str] | None = None
    license: list[str] | None = None
    task_type: list[str] | None = None
    domain: list[str] | None = None
    label_method: list[str] | None = None
    quality: list[int] | None = None
    quality_min: int | None = None
    nsfw: str = "exclude"
    pii: str = "any"
    needs_review: bool | None = None
    edited: bool | None = None
    commercial_only: bool = False
    redistributable_only: bool = False
    max_dups: int | None = None
    n_chars_min: int | None = None
    n_chars_max: int | None = None
    members: DataFrame | None = field(default=None, compare=False)
    q: str | None = None
    hits: DataFrame | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if self.nsfw not in ("exclude", "include", "only") or self.pii not in ("any", "only", "none"):
            raise ValueError("nsfw is exclude, include or only; pii is any, only or none")
        if self.quality_min is not None and (isinstance(self.quality_min, bool) or not 1 <= self.quality_min <= 3):
            raise ValueError("quality_min is 1, 2 or 3")
        if None not in (self.n_chars_min, self.n_chars_max) and self.n_chars_min > self.n_chars_max:
            raise ValueError("n_chars_min is over n_chars_max")
        for name, known in (("task_type", TASK_TYPES), ("domain", DOMAINS), ("license", [x[0] for x in LICENSES])):
            if unknown := [v for v in getattr(self, name) or [] if v not in known]:
                raise ValueError(f"unknown {name}: {unknown}")
        if any(isinstance(v, bool) or v not in (1, 2, 3) for v in self.quality or []):
            raise ValueError("quality is 1, 2 or 3")


LISTS = ("lang", "lang_variant", "source", "license", "task_type", "domain", "label_method", "quality")


def apply_filters(rows: DataFrame, f: Filters, ignore: str | None = None) -> DataFrame:
    """Rows that pass every filter but that on the column ``ignore``. Nulls pass ``exclude`` and fail ``quality_min``."""
    tests: list[Column] = [F.col(c).isin(v) for c in LISTS if (v := getattr(f, c)) is not None and c != ignore]
    if f.quality_min is not None and ignore != "quality":
        tests.append(F.col("quality") >= f.quality_min)
    if f.nsfw != "include" and ignore != "nsfw":
        tests.append(F.col("nsfw").eqNullSafe(True) if f.nsfw == "only" else ~F.col("nsfw").eqNullSafe(True))
    if f.pii != "any" and ignore != "pii_found":
        tests.append(F.col("pii_found").eqNullSafe(f.pii == "only"))
    for c in ("needs_review", "edited"):
        if (v := getattr(f, c)) is not None and c != ignore:
            tests.append(F.col(c).eqNullSafe(True) if v else ~F.col(c).eqNullSafe(True))
    tests += [F.col("commercial_ok")] * f.commercial_only + [F.col("redistributable")] * f.redistributable_only
    if f.max_dups is not None:
        tests.append(F.col("n_exact_dups") <= f.max_dups)
    if f.n_chars_min is not None and ignore != "n_chars_bucket":
        tests.append(F.col("n_chars") >= f.n_chars_min)
    if f.n_chars_max is not None and ignore != "n_chars_bucket":
        tests.append(F.col("n_chars") <= f.n_chars_max)
    if f.q is not None and f.hits is None and (words := parse_query(f.q)):
        tests.append(matches(F.col("text"), words))
    for test in tests:
        rows = rows.filter(test)
    if f.hits is not None:
        rows = rows.join(f.hits.select("id"), "id", "left_semi")
    return rows if f.members is None else rows.join(f.members.select("id"), "id", "left_semi")


def with_hits(rows: DataFrame, f: Filters) -> Filters:
    """O-F10, O-X6: the filters with the ids that their query meets, searched and written once for all facets.

    A query without words filters nothing. The ids lie in the shared scratch folder.
    """
    if f.q is None or not parse_query(f.q):
        return f
    folder = f"{scratch_dir(rows.sparkSession)}/hits-{uuid.uuid4().hex}"
    search(rows, f.q).write.parquet(folder)
    return replace(f, hits=rows.sparkSession.read.parquet(folder))


def facets_joint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """O-G2: counts by value of each column in one scan: facet, value, n."""
    held = rows.select(*[F.col(c).cast("string").alias(c) for c in columns])
    sets = held.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    most = (1 << len(columns)) - 1
    named = [(most ^ (1 << (len(columns) - 1 - i)), c) for i, c in enumerate(columns)]
    facet = F.coalesce(*[F.when(F.col("g") == g, c) for g, c in named])
    value = F.coalesce(*[F.when(F.col("g") == g, F.col(c)) for g, c in named])
    return sets.select(facet.alias("facet"), value.alias("value"), "n")


def facets_unfiltered(rows: DataFrame, f: Filters, columns: list[str]) -> DataFrame:
    """O-G1, O-G3: each column counted under all filters but its own.

    Columns without a filter share one scan; each filtered one has its own.
    """
    own = [c for c in columns if getattr(f, c, None) is not None or (c == "quality" and f.quality_min is not None) or (c == "nsfw" and f.nsfw != "include") or (c == "pii_found" and f.pii != "any") or (c == "n_chars_bucket" and (f.n_chars_min, f.n_chars_max) != (None, None))]
    shared = [c for c in columns if c not in own]
    parts = [facets_joint(apply_filters(rows, f), shared)] if shared else []
    parts += [apply_filters(rows, f, c).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("facet"), "value", "n") for c in own]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def facet_with_zeros(rows: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """O-G5: position, value, n: the vocabulary in its order with zeros, other values by count, null last."""
    words = rows.sparkSession.createDataFrame([(i, v) for i, v in enumerate(vocabulary)], "place int, value string")
    counted = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    met = F.broadcast(words).join(counted, "value", "full")
    return met.select(
        F.when(F.col("place").isNotNull(), F.col("place")).when(F.col("value").isNull(), 1_000_001).otherwise(1_000_000).alias("place"), "value", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    ).unionByName(counted.filter("value IS NULL").select(F.lit(1_000_001).alias("place"), "value", "n")).distinct()


# Sort orders; every one ends in the id, so pages never overlap.
def sort_order(sort: str, seed: int = 0) -> list[Column]:
    """O-Q3, O-Q4. ``relevance`` needs a column score (BM25, negative), ``dups`` a column n_exact_dups."""
    mixed = (F.col("id") * 2654435761 + F.lit(seed * 40503)) % 4294967291 * 279470273 % 1000003
    return {
        "relevance": [F.col("score").asc(), F.col("id")],
        "newest": [F.col("created_ts").desc_nulls_last(), F.col("id").desc()],
        "oldest": [F.col("created_ts").asc_nulls_first(), F.col("id")],
        "shortest": [F.col("n_chars").asc(), F.col("id")],
        "longest": [F.col("n_chars").desc(), F.col("id")],
        "dups": [F.col("n_exact_dups").desc(), F.col("id")],
        "random": [mixed.asc(), F.col("id")],
    }[sort]


def effective_sort(sort: str, searching: bool) -> str:
    """O-Q5."""
    return "newest" if sort == "relevance" and not searching else sort


def page(rows: DataFrame, sort: str, number: int, size: int, seed: int = 0) -> DataFrame:
    """O-Q6: rows of the page counted from 1; offsets end at 100,000."""
    offset = min((number - 1) * size, 100_000)
    return rows.orderBy(*sort_order(sort, seed)).offset(offset).limit(size)


def hydrate(rows: DataFrame, ids: list[int]) -> DataFrame:
    """O-Q9: rows of a list of ids with their place in it."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(ids)), "place long, id long")
    return rows.join(F.broadcast(wanted), "id")


_TERM = r"[^\p{L}\p{N}]+"
_ACCENTED, _PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy"


def folded(text: Column) -> Column:
    """O-X3: lower case without accents."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), _ACCENTED, _PLAIN)


def terms(text: Column) -> Column:
    return F.filter(F.split(folded(text), _TERM), lambda x: x != "")


def parse_query(q: str, most: int = 24) -> list[tuple[list[str], bool]]:
    """O-X1, O-X2: (words of a term or phrase, whether it is a prefix); a query of signs alone gives none."""
    found = []
    for phrase, word in re.findall(r'"([^"]*)"|(\S+)', q):
        prefix = bool(word) and word.endswith("*")
        plain = (phrase or word).lower().translate(str.maketrans(_ACCENTED, _PLAIN))
        if words := [w for w in re.split(r"[\W_]+", plain) if w]:
            found.append((words, prefix))
    return found[:most]


def inverted_index(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, term, tf, len: term frequencies with the document's length in terms."""
    held = rows.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("all"))
    spread = held.select("id", F.size("all").alias("len"), F.explode("all").alias("term"))
    return spread.groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def search(rows: DataFrame, q: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """O-X4: ids of rows that hold every word, phrase and prefix of a query."""
    wanted = parse_query(q)
    found = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return found.filter(matches(F.col("text"), wanted)).select("id") if wanted else found.select("id").limit(0)


def matches(text: Column, wanted: list[tuple[list[str], bool]]) -> Column:
    """Whether a text holds all words, phrases and prefixes of a parsed query; its terms are made once."""
    padded = F.concat(F.lit(" "), F.array_join(terms(text), " "), F.lit(" "))
    parts = [F.lit(" " + " ".join(words) + ("" if prefix else " ")) for words, prefix in wanted]
    return F.exists(F.array(padded), lambda p: reduce(and_, [F.contains(p, part) for part in parts]))


def _times(word: str) -> Column:
    return F.size(F.filter("all", lambda x: x == word))


def bm25(rows: DataFrame, q: str, id_col: str = "id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """O-X5: id, score of rows that hold every word; lower is better. Statistics cover the whole table.

    Only the query's words are counted by row, so nothing but hits is shuffled.
    """
    words = sorted({w for ws, _ in parse_query(q) for w in ws})
    held = rows.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("all")).select("id", F.size("all").alias("len"), *[_times(w).alias(f"tf{i}") for i, w in enumerate(words)])
    totals = held.agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.greatest(F.log((F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        score = score - idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
        held = held.filter(F.col(f"tf{i}") > 0)
    return held.crossJoin(F.broadcast(totals)).select("id", score.alias("score"))  # totals is one row


def snippet(text: Column, words: list[str], size: int = 18) -> Column:
    """O-X7: up to ``size`` words around the first hit, hits marked."""
    shown = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    is_hit = lambda x: folded(F.regexp_replace(x, _TERM, "")).isin(words)
    at = F.coalesce(F.array_position(F.transform(shown, is_hit), F.lit(True)), F.lit(1))
    start = F.greatest(at.cast("int") - size // 2, F.lit(1))
    return F.array_join(F.transform(F.slice(shown, start, F.lit(size)), lambda x: F.when(is_hit(x), F.concat(F.lit("<mark>"), x, F.lit("</mark>"))).otherwise(x)), " ")


def top_similar(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """O-V2, O-V3: the k rows of greatest cosine, ties by id; exact, as every row is scored."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = dot(F.col(vec_col), q) / F.greatest(norm(F.col(vec_col)) * norm(q), F.lit(1e-12))
    return vectors.select(F.col(id_col).alias("id"), score.alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """O-V5, O-J7: one row: keys of each side, and the share of them that the other side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    met = a.withColumn("in_a", F.lit(1)).join(b.withColumn("in_b", F.lit(1)), key, "full")
    n = met.agg(F.count("in_a").alias("n_left"), F.count("in_b").alias("n_right"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("n_both"))
    return n.select("*", (F.col("n_both") / F.col("n_left")).alias("left_covered"), (F.col("n_both") / F.col("n_right")).alias("right_covered"))


def add_members(collection: DataFrame, ids: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-E1, O-E3: the collection with the ids that exist, and counts added, already, not_found."""
    wanted = ids.select("id").distinct()
    state = wanted.join(rows.select("id", F.lit(True).alias("exists")).distinct(), "id", "left").join(collection.select("id", F.lit(True).alias("held")).distinct(), "id", "left")
    counts = state.agg(F.count_if(F.col("exists") & F.col("held").isNull()).alias("added"), F.count_if(F.col("held")).alias("already"), F.count_if(F.col("exists").isNull()).alias("not_found"))
    return collection.select("id").union(wanted.join(rows, "id", "left_semi")).distinct(), counts


def remove_members(collection: DataFrame, ids: DataFrame) -> DataFrame:
    """O-E2."""
    return collection.join(ids, "id", "left_anti")


def overlay(rows: DataFrame, edits: DataFrame, column: str) -> DataFrame:
    """O-E4, O-E5: rows under their latest edit; one that reverts (a null value) restores the original."""
    last = edits.groupBy("id").agg(F.max_by("value", "at").alias("_value"))
    met = rows.join(last, "id", "left")
    return met.select(*[c for c in rows.columns if c != column], F.coalesce("_value", column).alias(column), F.col(column).alias(f"{column}_original"), F.col("_value").isNotNull().alias("is_edited"))


def license_class(commercial: Column, redistributable: Column, license: Column) -> Column:
    """O-E10."""
    return F.when(~redistributable, "bloqueada").when(~commercial, "nao-comercial").when(license.contains("-sa-"), "viral").otherwise("livre")


def export_rows(rows: DataFrame, include_blocked: bool = False, cap: int | None = None) -> DataFrame:
    """O-E7: without rows that may not be redistributed; a cap takes the least ids."""
    kept = rows if include_blocked else rows.filter("redistributable")
    return kept if cap is None else kept.orderBy("id").limit(cap)


def manifest(rows: DataFrame) -> DataFrame:
    """O-E8: one row of counts; by language and licence as sorted lists of structs."""
    blocked = F.count_if(~F.col("redistributable")).alias("n_blocked")
    kept = rows.filter("redistributable")
    by = lambda c: kept.groupBy(c).agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(c), F.col("n")))), ",").alias(f"by_{c}"))
    one = kept.agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("commercial_ok")).alias("n_non_commercial"), F.count_if("nsfw").alias("n_nsfw"), F.count_if("pii_found").alias("n_pii"), F.count_if("edited").alias("n_edited"), F.max("n_chars").alias("max_chars")
    )
    return one.crossJoin(rows.agg(blocked)).crossJoin(by("lang")).crossJoin(by("license"))  # one row each



# The fields of an exported record, in their order.
FLAT = [
    "uid", "text", "lang", "lang_variant", "task_type", "domain", "quality", "nsfw", "pii_found", "source", "source_id", "license", "commercial_ok", "redistributable",
    "attribution", "label_method", "label_confidence", "needs_review", "edited", "n_chars", "n_words", "n_exact_dups", "n_near_dups", "country", "model_family", "created_ts",
    "native_category", "taxonomy_version",
]


def flat_records(rows: DataFrame, attribution: DataFrame, taxonomy_version: str, include_original: bool = False) -> DataFrame:
    """O-E6: the export record; ``attribution`` has one row a source. A null text_original means that the text never changed."""
    met = rows.join(attribution.select("source", "attribution"), "source", "left").withColumn("taxonomy_version", F.lit(taxonomy_version))
    original = [F.coalesce("text_original", "text").alias("text_original")] if include_original else []
    return met.select(*FLAT, *original)


def memberships(items: DataFrame, collections: DataFrame) -> DataFrame:
    """O-Q12: id, names: the collections that hold an item, ordered by name; repeated rows count once."""
    named = items.select("id", "collection").distinct().join(collections, "collection")
    return named.groupBy("id").agg(F.sort_array(F.collect_list("name")).alias("names"))


def similarity_envelope(allowed: DataFrame, vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """O-V6: one row: candidates with a vector, rows without one, k, how many are returned, the best similarity."""
    met = allowed.select("id").join(vectors.select(F.col("vec_id").alias("id"), F.lit(True).alias("held")), "id", "left")
    counts = met.agg(F.count("held").alias("n_candidates"), F.count_if(F.col("held").isNull()).alias("n_without_vector"))
    best = top_similar(vectors.join(allowed.select(F.col("id").alias("vec_id")), "vec_id", "left_semi"), query, k)
    return counts.crossJoin(best.agg(F.count("*").alias("n_returned"), F.max("similarity").alias("best"))).withColumn("k", F.lit(k))  # one row each


def top_similar_blocks(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """O-V4: ``top_similar`` by matrix products over Arrow batches; each gives its k best, so k rows a batch are sorted.

    A float32 matrix is scored in doubles, which keeps the ranking. Rows without a vector are left out.
    """

    def score(batches):
        import numpy as np
        import pyarrow as pa

        q = np.asarray(query, dtype=np.float64)
        q_norm = np.linalg.norm(q)
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, len(q))
            similarity = block @ q / np.maximum(np.linalg.norm(block, axis=1) * q_norm, 1e-12)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            best = np.lexsort((ids, -similarity))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(ids[best], pa.int64()), pa.array(similarity[best])], names=["id", "similarity"])

    held = vectors.select(F.col(id_col).cast("long"), F.col(vec_col)).filter(F.col(vec_col).isNotNull())
    return held.mapInArrow(score, "id long, similarity double").orderBy(F.desc("similarity"), "id").limit(k)
