"""Secret scans: three fixed patterns and a token-efficiency test for random strings.

Base kinds, each leftmost and non-overlapping, failing matches dropped: ``assign``
(a named credential with a value of 6 or more characters), ``access`` (AKIA keys
of 20 or more), ``hex`` (runs of 24 or more). The test adds ``random``: a run of
key characters with letters and digits whose characters per token, under a byte
level BPE vocabulary, fall below ``ratio``: prose words are long tokens, random
strings are short ones. Known digests (whole hex runs of 32, 40, 56, 64, 96 or 128
characters), UUIDs and identifiers (words and numbers joined by separators, such
as page_12 or 2024-01-31) are left out, as is whatever a base span already holds.

Spans count code points, end exclusive, over whole texts. Null and empty texts
have none. Repeated rows get the same result; an empty table gives an empty one;
further columns are not looked at.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.blocks import map_arrow
from quarry.llm.shared import ship

ship(__name__)

KINDS = ("assign", "access", "hex", "random")
MIN_RANDOM = 20
RATIO = 2.0

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RANDOM)
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_SIZES = {32, 40, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
_PART = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)\Z")
_SEPARATORS = re.compile(r"[-_/=+]+")


def encoder(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_identifier(run: str) -> bool:
    """Digests of known sizes, UUIDs, and words or numbers joined by separators."""
    if len(run) in _DIGEST_SIZES and _DIGEST.match(run) or _UUID.match(run):
        return True
    return all(_PART.match(p) for p in _SEPARATORS.split(run) if p)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, tokens, held: list[tuple[int, int, int]], ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """Runs that fail the token-efficiency test and overlap none of the spans ``held``."""
    found, at, reach = [], 0, 0
    for m in _RUN.finditer(text):
        run, start, end = m[0], m.start(), m.end()
        while at < len(held) and held[at][0] < end:
            reach, at = max(reach, held[at][2]), at + 1
        if reach > start or run.isalpha() or run.isdigit() or is_identifier(run):
            continue
        if not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
            continue
        if len(run) < ratio * tokens(run):
            found.append((start, 3, end))
    return found


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """One row for each input row: id, n_assign, n_access, n_hex, n_random, base_spans, spans (kind:start:end, comma-joined)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "n_assign", "n_access", "n_hex", "n_random", "base_spans", "spans"]

    def run(batches):
        encoding = encoder(ranks_path, pattern)

        def tokens(s):
            return len(encoding.encode_ordinary(s))

        for batch in batches:
            out = []
            for text in batch.column("text"):
                whole = text.as_py() or ""
                base = base_spans(whole)
                spans = sorted(base + random_spans(whole, tokens, base, ratio))
                count = [sum(s[1] == k for s in spans) for k in range(4)]
                out.append((*count, _told(base), _told(spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=names)

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(n, T.LongType()) for n in names[1:5]), *(T.StructField(n, T.StringType()) for n in names[5:])])
    return map_arrow(rows, run, schema).withColumnRenamed("id", id_col)
