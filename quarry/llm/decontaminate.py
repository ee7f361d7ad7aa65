"""Benchmark decontamination through a positional inverted index.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased. A window is
``window`` consecutive words of a benchmark item; an item of fewer words, but not
none, is one window. The steps:

1. count, over the whole corpus, the terms that benchmark items use;
2. rank each window's terms by that count; a window with a term that the corpus
   lacks cannot occur and goes;
3. store postings (term, row, position) of the two rarest terms of each window, and
   one posting at the end of each row, whose position is its number of words;
4. shift the rarest term's list by its offset to candidate starts, and intersect
   them with the second list, shifted likewise, by an equality join;
5. store the postings of the windows' other terms in rows that still have
   candidates, and intersect those lists too: a start that every term of its
   window confirms is an exact phrase match.

Rows, terms and positions alone are shuffled, never texts. Terms are numbered, so
lists meet on equal words and not on hashes.

Null and empty texts have no words. Rows that repeat id and text get the same
result. An empty corpus or benchmark gives no matches. Repeated items count by
their distinct item_id. Further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.llm.shared import ascii_lower, broadcast_if_small, key_filter, materialise, may_hold, row_key, text_or_empty, without_keys

#: Between two words: anything but a single space, which is split at as it is.
GAP = r"[\x00-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F][\x00-\x2F\x3A-\x60\x7B-\x7F]*| [\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: The number of the posting that ends a row; it stands for no term.
END = -1


def words(text_col: str) -> Column:
    """A split at a single character is many times as fast as a pattern's matches."""
    spaced = F.regexp_replace(ascii_lower(text_or_empty(text_col)), GAP, " ")
    return F.array_remove(F.split(spaced, " "), "")


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Windows of each item: wid (digest of the terms), terms and item (the id as a string)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(text_col).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)))
    cut = items.select("item", "all", F.explode(starts).alias("at")).select("item", F.slice("all", F.col("at"), window).alias("terms"))
    return cut.select(F.unhex(F.md5(F.array_join("terms", " "))).alias("wid"), "terms", "item").distinct()


def numbered(terms: DataFrame) -> DataFrame:
    """Distinct terms (one column, term) with a number, tid; written, so that numbers stay."""
    return materialise(terms.distinct().select("term", F.monotonically_increasing_id().alias("tid")), "vocabulary")


def term_counts(docs: DataFrame, vocabulary: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each numbered term occurs in the whole corpus: tid, n."""
    tokens = docs.select(F.explode(words(text_col)).alias("term"))
    return tokens.join(broadcast_if_small(vocabulary), "term").groupBy("tid").agg(F.count("*").alias("n"))


def ranked_terms(windows: DataFrame, vocabulary: DataFrame, counts: DataFrame) -> DataFrame:
    """The terms of each window from the rarest on: wid, rank (from 1), tid, offset, length.

    Windows with a term that does not occur in the corpus are left out.
    ``counts`` is materialised.
    """
    known = materialise(vocabulary.join(broadcast_if_small(counts), "tid"), "counted")
    places = windows.select("wid", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term")).join(broadcast_if_small(known), "term")
    whole = W.partitionBy("wid")  # at most one window's words
    ranked = places.withColumn("found", F.count("*").over(whole)).filter("found = length")
    return ranked.withColumn("rank", F.row_number().over(whole.orderBy("n", "term", "offset"))).select("wid", "rank", "tid", "offset", "length")


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", ends: bool = False) -> DataFrame:
    """The inverted index of ``terms`` (term, tid): tid, row, pos for each occurrence in the corpus.

    With ``ends`` each row has one more posting, of tid ``END`` at the position after
    its last word, with the row's id in a further column, id.
    """
    # The key is made below the explode: beside it, it would be made again for each word.
    held = F.array_append(words(text_col), F.lit("")) if ends else words(text_col)
    named = docs.select(row_key(id_col, text_col).alias("row"), F.col(id_col).alias("id"), held.alias("all"))
    tokens = named.select("row", "id", F.posexplode("all").alias("pos", "term"))
    if not ends:
        return tokens.join(broadcast_if_small(terms), "term").select("tid", "row", "pos")
    wanted = materialise(terms.select("term", "tid").unionByName(terms.sparkSession.createDataFrame([("", END)], "term string, tid long")), "wanted")
    return tokens.join(broadcast_if_small(wanted), "term").select("tid", "row", "pos", F.when(F.col("tid") == END, F.col("id")).alias("id"))


def candidate_starts(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """Offset-adjusted intersection of the lists of each window's two rarest terms: wid, row, start, length."""
    first = materialise(ranked.filter("rank = 1").select("wid", "tid", "offset", "length"), "first")
    starts = index.join(broadcast_if_small(first), "tid").select("wid", "row", (F.col("pos") - F.col("offset")).alias("start"), "length").filter("start >= 0")
    second = materialise(ranked.filter("rank = 2").select("wid", "tid", "offset"), "second")
    expected = starts.filter("length > 1").join(broadcast_if_small(second), "wid")
    expected = expected.select("wid", "row", "start", "length", "tid", (F.col("start") + F.col("offset")).alias("pos"))
    both = expected.join(index.select("tid", "row", "pos"), ["tid", "row", "pos"], "left_semi").select("wid", "row", "start", "length")
    return both.unionByName(starts.filter("length = 1")).distinct()


def confirmed_starts(docs: DataFrame, found: DataFrame, ranked: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The candidates of which every further term of the window stands in its place: wid, row, start, length."""
    rest = materialise(ranked.filter("rank > 2").select("wid", "tid", "offset"), "rest")
    rows = key_filter(materialise(found.filter("length > 2").select("row").distinct(), "rows"))
    near = may_hold(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row")), "row", rows).filter("__q_may")
    terms = materialise(vocabulary.join(rest.select("tid").distinct(), "tid", "left_semi"), "terms")
    index = postings(near, terms, "id", "text")
    expected = found.filter("length > 2").join(broadcast_if_small(rest), "wid")
    expected = expected.select("wid", "row", "start", "length", "tid", (F.col("start") + F.col("offset")).alias("pos"))
    met = expected.join(index, ["tid", "row", "pos"], "left_semi").groupBy("wid", "row", "start", "length").agg(F.count("*").alias("n"))
    return met.filter("n = length - 2").drop("n").unionByName(found.filter("length <= 2"))


def phrase_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact matches (wid, row, start, length), the windows' items (wid, item), and a
    posting for each input row's end (row, pos: its number of words, id)."""
    held = materialise(benchmark_windows(benchmark, item_col, item_text, window), "windows")
    windows = held.select("wid", "terms").dropDuplicates(["wid"])
    vocabulary = numbered(held.select(F.explode("terms").alias("term")))
    counts = materialise(term_counts(docs, vocabulary, text_col), "counts")
    ranked = materialise(ranked_terms(windows, vocabulary, counts), "ranked")
    anchors = vocabulary.join(ranked.filter("rank <= 2").select("tid").distinct(), "tid", "left_semi")
    index = materialise(postings(docs, anchors, id_col, text_col, ends=True), "postings")
    found = materialise(candidate_starts(index.filter(F.col("tid") != END), ranked), "candidates")
    hits = materialise(confirmed_starts(docs, found, ranked, vocabulary, id_col, text_col), "hits")
    return hits, held.select("wid", "item"), index.filter(F.col("tid") == END).select("row", "pos", "id")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """One row for each input row: id, n_words, n_hit, items (sorted ids as strings), contaminated."""
    hits, items, ends = phrase_matches(docs, benchmark, id_col, text_col, item_col, item_text, window)
    covered = hits.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    n_hit = covered.groupBy("row").agg(F.count("*").alias("n_hit"))
    named = hits.select("row", "wid").distinct().join(broadcast_if_small(items), "wid").select("row", "item").distinct()
    told = n_hit.join(named.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")), "row")
    met = ends.join(broadcast_if_small(materialise(told, "told")), "row", "left")
    return met.select(
        F.col("id").alias(id_col),
        F.col("pos").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """The input's rows and columns without documents that hold any window of the benchmark."""
    hits, _, _ = phrase_matches(docs, benchmark, id_col, text_col, item_col, item_text, window)
    lost = materialise(hits.select(F.col("row").alias("__q_row")).distinct(), "lost")
    kept = without_keys(docs.withColumn("__q_row", row_key(id_col, text_col)), "__q_row", lost)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", depth: int = 3, span: int = 50
) -> DataFrame:
    """Rows where the ``depth`` rarest terms of an item stand within ``span`` words of the rarest.

    Returns row (its key), item, anchor (the rarest term's position). Lists meet on
    (row, block of ``span`` positions), so each posting is compared with three blocks.
    """
    whole = benchmark.select(F.col(item_col).cast("string").alias("wid"), F.explode(words(item_text)).alias("term")).distinct()
    whole = materialise(whole, "items")
    vocabulary = numbered(whole.select("term"))
    counts = materialise(term_counts(docs, vocabulary, text_col), "counts")
    by_item = W.partitionBy("wid").orderBy("n", "term")
    known = materialise(vocabulary.join(broadcast_if_small(counts), "tid"), "counted")
    ranked = whole.join(broadcast_if_small(known), "term").withColumn("rank", F.row_number().over(by_item)).filter(F.col("rank") <= depth)
    ranked = materialise(ranked.select("wid", "rank", "tid"), "ranked")
    anchors = materialise(vocabulary.join(ranked.select("tid").distinct(), "tid", "left_semi"), "anchors")
    index = materialise(postings(docs, anchors, id_col, text_col).distinct(), "postings")
    placed = index.join(broadcast_if_small(ranked), "tid").withColumn("block", F.floor(F.col("pos") / span))
    anchors = placed.filter("rank = 1").select("wid", "row", F.col("pos").alias("anchor"), "block")
    near = anchors.select("wid", "row", "anchor", F.explode(F.array(*[F.col("block") + k for k in (-1, 0, 1)])).alias("block"))
    others = placed.filter("rank > 1").select("wid", "row", "block", "pos", "rank")
    met = near.join(others, ["wid", "row", "block"]).filter(F.abs(F.col("pos") - F.col("anchor")) <= span)
    wanted = ranked.groupBy("wid").agg(F.count("*").alias("terms"))
    full = met.groupBy("wid", "row", "anchor").agg(F.countDistinct("rank").alias("others")).join(wanted, "wid").filter("others = terms - 1")
    single = anchors.join(wanted.filter("terms = 1"), "wid", "left_semi")
    return full.select("row", F.col("wid").alias("item"), "anchor").unionByName(single.select("row", F.col("wid").alias("item"), "anchor"))
