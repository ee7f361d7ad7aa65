"""BPE encoding and decoding through tables of distinct words.

Texts are split at ASCII white space. Spark counts the distinct words of the corpus
and encodes each of the commonest once; that table has at most ``TABLE_WORDS`` rows
of at most ``WORD_CHARS`` characters and goes to every task. A task takes texts in
blocks: it makes the table of the block's distinct words, fetches the ids of those
that the corpus table knows, encodes each other one once, and joins ids back by
position. Decoding joins ids with the id-to-piece table, which holds the whole
vocabulary. This is exact for a vocabulary that drops white space: neither its
normaliser nor its splitter looks across it.

A word that is rare in the corpus is so encoded once a block: a shuffled join of
every position with one table of all words moves more than the texts themselves.

Null and empty texts have no tokens; special tokens in a text are found as the
library finds them. Repeated rows get the same result, an empty table an empty
one; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quarry.llm.blocks import map_arrow, parts, split_words
from quarry.llm.shared import commonest, materialise, ship, text_or_empty

ship(__name__)

#: Most rows of the table that goes to every task, and most characters of a word there.
TABLE_WORDS = 200_000
WORD_CHARS = 64
#: Between two words: anything but a single space, which is split at as it is.
_GAP = r"[\x09-\x0D][\x20\x09-\x0D]*| [\x20\x09-\x0D]+"


def load(vocabulary: str) -> Tokenizer:
    found = Tokenizer.from_str(vocabulary)
    found.no_truncation()
    found.no_padding()
    return found


def read_vocabulary(path: str) -> str:
    """The tokenizer file's JSON, checked to have no decoder and to drop white space."""
    with open(path, encoding="utf-8") as f:
        told = f.read()
    if json.loads(told)["decoder"] is not None:
        raise ValueError("pieces are joined by one space, which holds for files without a decoder")
    return told


class _Encoder:
    """Encodes distinct words, many in one text: a special token parts them, which the
    library takes out before it normalises or splits what stands around it."""

    def __init__(self, vocabulary: str, mark: tuple[str, int]):
        self.tokenizer = load(vocabulary)
        self.mark, self.sign = mark

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def lists(self, words: list[str]) -> pa.ListArray:
        """The ids of each word; none for a word without tokens."""
        odd = [self.mark in w for w in words]
        ids, counts = [np.empty(0, np.int32)], []

        def encoded(text: str) -> None:
            held = np.array(self._ids(text), np.int32)
            cuts = np.flatnonzero(held == self.sign)
            ids.append(held[held != self.sign])
            counts.extend((np.diff([-1, *cuts, len(held)]) - 1).tolist())

        start = 0
        while start < len(words):
            end = start
            while end < len(words) and end < start + 500 and not odd[end]:
                end += 1
            if end > start:
                encoded(self.mark.join(words[start:end]))
            else:  # a word that holds the mark itself
                ids.append(np.array(self._ids(words[start]), np.int32))
                counts.append(len(ids[-1]))
            start = max(end, start + 1)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))


def _mark(vocabulary: str) -> tuple[str, int]:
    """A special token that the library finds as it stands, and its id."""
    mark = next(t for t in json.loads(vocabulary)["added_tokens"] if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]))
    return mark["content"], mark["id"]


def word_table(docs: DataFrame, vocabulary: str, text_col: str = "text", table_words: int = TABLE_WORDS) -> DataFrame:
    """The commonest distinct words, each encoded once: word (UTF-8), ids (a list)."""
    spaced = F.regexp_replace(text_or_empty(text_col), _GAP, " ")
    words = docs.select(F.explode(F.split(spaced, " ")).alias("word")).filter((F.col("word") != "") & (F.length("word") <= WORD_CHARS))
    counts = materialise(words.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1"), "words")

    mark = _mark(vocabulary)

    def run(batches):
        encoder = _Encoder(vocabulary, mark)
        for batch in batches:
            words = batch.column("word")
            yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), encoder.lists(words.to_pylist())], names=["word", "ids"])

    return map_arrow(commonest(counts, table_words).select("word"), run, "word binary, ids array<int>")


def _piece_names(vocabulary: str) -> list[str]:
    """The piece of each id from 0 on; empty where an id is not given."""
    known = load(vocabulary).get_vocab(with_added_tokens=True)
    out = [""] * (max(known.values()) + 1)
    for piece, i in known.items():
        out[i] = piece
    return out


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", table_words: int = TABLE_WORDS, digests: bool = False) -> DataFrame:
    """One row for each input row: id, n_tokens, ids and decoded text.

    ``ids`` are decimal and joined by one space. With ``digests`` the last two are
    lower-case hex SHA-256 of their UTF-8 instead, named ids_sha256, decoded_sha256.
    """
    table = word_table(docs, vocabulary, text_col, table_words).toArrow().combine_chunks()  # at most table_words rows
    held = [table.column(c).combine_chunks() if table.num_rows else pa.array([], k) for c, k in (("word", pa.binary()), ("ids", pa.list_(pa.int32())))]
    names_of = _piece_names(vocabulary)
    by_id = pa.array(names_of, pa.string()), pa.array([str(i) for i in range(len(names_of))], pa.string())
    sent = docs.sparkSession.sparkContext.broadcast((held[0].cast(pa.binary()), held[1].cast(pa.list_(pa.int32())), *by_id))
    mark = _mark(vocabulary)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["id", "n_tokens", "ids", "decoded"]

    def told(pieces: pa.Array, starts: np.ndarray) -> pa.Array:
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pieces), " ")
        return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in joined], pa.string()) if digests else joined

    def run(batches):
        encoder, (common, lists, pieces, digits) = _Encoder(vocabulary, mark), sent.value
        for batch in batches:
            for part in parts(batch, "text"):
                codes, words, starts = split_words(part.column("text"))
                at = pc.index_in(words, value_set=common)
                rare = encoder.lists(words.filter(pc.is_null(at)).cast(pa.string()).to_pylist())
                place = at.to_numpy(zero_copy_only=False)
                new = np.isnan(place) if place.dtype.kind == "f" else np.zeros(len(place), bool)
                place = np.where(new, len(lists) + np.cumsum(new) - 1, np.nan_to_num(place)).astype(np.int64)
                of_word = pa.concat_arrays([lists, rare]).take(pa.array(place))  # ids of each distinct word of the block
                counts = pc.list_value_length(of_word).to_numpy(zero_copy_only=False)[codes]
                ids = of_word.take(pa.array(codes)).flatten()  # joined back by position
                ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[starts]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(ends), pa.int64()), told(digits.take(ids), ends), told(pieces.take(ids), ends)], names=names)

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField(names[2], T.StringType()), T.StructField(names[3], T.StringType())])
    return map_arrow(rows, run, schema).withColumnRenamed("id", id_col)


def pieces(vocabulary: str, spark) -> DataFrame:
    """The id-to-piece table (id, piece): as many rows as the vocabulary."""
    return spark.createDataFrame(list(enumerate(_piece_names(vocabulary))), "id long, piece string")


def decode(encoded: DataFrame, vocabulary: str, key_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id lists (decimal, joined by spaces) by a join with the id-to-piece table: key, decoded.

    Keys must be unique. The vocabulary's size bounds the broadcast.
    """
    ids = encoded.select(F.col(key_col).alias("key"), F.posexplode(F.split(F.coalesce(ids_col, F.lit("")), " ")).alias("pos", "id")).withColumn("id", F.expr("try_cast(id AS long)"))
    met = ids.join(F.broadcast(pieces(vocabulary, encoded.sparkSession)), "id", "left")
    kept = F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))
    return met.groupBy("key").agg(F.array_join(F.transform(F.array_sort(kept), lambda x: x["piece"]), " ").alias("decoded")).withColumnRenamed("key", key_col)
