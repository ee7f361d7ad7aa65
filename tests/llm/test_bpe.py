import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("table_words", [100_000, 50])
def test_same_as_the_library(odd, documents, table_words):
    library = Tokenizer.from_file(PATH)
    vocabulary = bpe.read_vocabulary(PATH)
    for docs in (odd.withColumn("word", F.lit(1)).withColumn("key", F.lit(1)), documents):
        rows = docs.collect()
        want = []
        for r in rows:
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))
        got = bpe.encode(docs, vocabulary, table_words=table_words)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        hashed = bpe.encode(docs, vocabulary, table_words=table_words, digests=True)
        assert sorted((tuple(r) for r in hashed.collect()), key=repr) == sorted(((a, b, sha(c), sha(d)) for a, b, c, d in want), key=repr)


def test_decode_by_join(documents):
    vocabulary = bpe.read_vocabulary(PATH)
    told = bpe.encode(documents, vocabulary)
    back = bpe.decode(told, vocabulary).withColumnRenamed("decoded", "again")
    assert told.join(back, "doc_id").filter("decoded <> again").count() == 0
    assert back.count() == documents.count()


def test_empty(no_docs):
    assert bpe.encode(no_docs, bpe.read_vocabulary(PATH)).count() == 0
