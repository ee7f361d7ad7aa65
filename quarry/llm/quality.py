"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is the number of tests it passes: 0 for bad and toxic, 1 for
one of the two, 2 for good and clean. One weight vector over hashed text features
is shared by all grades, and ordered thresholds cut its score:
``P(grade <= k) = sigmoid(threshold_k - score)``. From it come the expected grade
and the tail probability ``P(grade >= select)`` that selects documents.

Features of a whole text, hashed to ``2 ** BITS`` places: each distinct lower-cased
word (presence), and the share of tokens of each shape (runs of letters, digits and
marks reduced to one sign) and of tokens that repeat the one before. An L1
penalty on the words leaves those that the grades depend on.

The fit uses at most ``MAX_ROWS`` labelled documents, those with the least hash of
their id, and words that at least ``MIN_ROWS`` of them hold. Everything else covers
all documents. Null and empty texts have no features and get the score zero. A
document with several labels takes the least grade; null labels and ids are left
out. Without labels, or with one grade only, nothing can be told apart: every
document gets the top grade's constant. Repeated rows get the same result. An empty
table gives an empty result; further columns, whatever their names, are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.blocks import map_arrow
from quarry.llm.shared import ship

ship(__name__)

BITS = 18
#: The bound of the training sample, and how many of its documents must hold a word.
MAX_ROWS = 6_000
MIN_ROWS = 8
GRADES = 3
SELECT = 2
THRESHOLD = 0.55
#: Most tokens that a worker remembers.
CACHED = 1 << 18

_WORD = re.compile(r"\w+")
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"([^\w\s])\1*")


def _place(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}{value}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


_REPEAT = _place("r:", "")


def _shape(token: str) -> str:
    """Cases, digits and marks of a token: 'The***' is 'Aa*', 'THE!!' is 'A!', '12' is '0'."""
    told = _LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", token)
    told = re.sub(r"\d+", "0", told)
    return _MARKS.sub(lambda m: m[1] + ("+" if len(m[0]) > 1 else ""), told)[:24]


class _Places(dict):
    """token -> (places of its words, place of its shape); emptied when it is full."""

    def __missing__(self, token: str) -> tuple[tuple[int, ...], int]:
        if len(self) >= CACHED:
            self.clear()
        self[token] = found = tuple(_place("w:", w) for w in _WORD.findall(token.lower())), _place("s:", _shape(token))
        return found


def features(text: str | None, places: _Places | None = None) -> tuple[list[int], dict[int, float]]:
    """Places of distinct words, and shares of shapes and repeats by place."""
    tokens = (text or "").split()
    if not tokens:
        return [], {}
    places = _Places() if places is None else places
    words: set[int] = set()
    shares: dict[int, float] = {_REPEAT: sum(map(eq, tokens, islice(tokens, 1, None))) / len(tokens)}
    for token, n in Counter(tokens).items():
        held, shape = places[token]
        words.update(held)
        shares[shape] = shares.get(shape, 0.0) + n / len(tokens)
    return sorted(words), shares


@dataclass
class Model:
    """Weights of places that have one, and the ordered thresholds below grades 1, 2, ..."""

    weights: dict[int, float]
    thresholds: list[float]

    def scorer(self) -> Callable[[str | None], float]:
        """score(text), with a bounded memory of tokens: most have no weighted word."""
        weights, seen = self.weights, _Places()
        known: dict[str, tuple[tuple[int, ...], float]] = {}

        def weigh(token: str) -> tuple[tuple[int, ...], float]:
            if len(known) >= CACHED:
                known.clear()
            words, shape = seen.__missing__(token)
            seen.clear()
            known[token] = found = tuple(p for p in words if p in weights), weights.get(shape, 0.0)
            return found

        def score(text: str | None) -> float:
            tokens = (text or "").split()
            if not tokens:
                return 0.0
            words: set[int] = set()
            shape = weights.get(_REPEAT, 0.0) * sum(map(eq, tokens, islice(tokens, 1, None)))
            for token, n in Counter(tokens).items():
                held, weight = known.get(token) or weigh(token)
                shape += weight * n
                if held:
                    words.update(held)
            return shape / len(tokens) + sum(weights[p] for p in sorted(words))

        return score

    def tails(self, score: float) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..."""
        return [float(1 / (1 + np.exp(np.clip(t - score, -500, 500)))) for t in self.thresholds]


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One grade for each labelled document: quality plus one if it is not toxic."""
    whole = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return whole.groupBy(F.col(id_col).alias("id")).agg(F.min(F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """grade, words, places, shares of the sample: max_rows labels decide which texts are read."""
    chosen = graded(labels, id_col).withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("order", "id", "grade", "text")

    def run(batches):
        for batch in batches:
            places = _Places()
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                told = [features(t.as_py(), places) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("order"), part.column("grade"), pa.array([t[0] for t in told], pa.list_(pa.int32())), pa.array([list(t[1]) for t in told], pa.list_(pa.int32())), pa.array([list(t[1].values()) for t in told], pa.list_(pa.float64()))],
                    names=["order", "grade", "words", "places", "shares"],
                )

    found = map_arrow(rows, run, "order long, grade int, words array<int>, places array<int>, shares array<double>")
    return found.orderBy("order", "grade", F.size("words"), "words").limit(max_rows)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(rows: list, grades: int = GRADES, min_rows: int = MIN_ROWS) -> Model:
    """A strict L1 fit chooses the places, a second fit of these alone sets their weights free.

    ``rows`` have grade, words, places, shares.
    """
    first = _descend(rows, grades, min_rows, 0.006, None)
    return _descend(rows, grades, min_rows, 0.0002, set(first.weights)) if first.weights else first


def _descend(rows: list, grades: int, min_rows: int, l1: float, only: set[int] | None, l2: float = 0.0002, steps: int = 400) -> Model:
    """Proximal gradient descent, scaled by each weight's own gradients, on the cumulative-link likelihood.

    The thresholds are a first value and non-negative steps, so they stay ordered.
    """
    y = np.array([r["grade"] for r in rows], int)
    if len(set(y.tolist())) < 2:
        return Model({}, [-50.0] * (grades - 1))
    held = Counter(p for r in rows for p in set(r["words"]))
    shares = sorted({p for r in rows for p in r["places"] if only is None or p in only})
    words = sorted(p for p, n in held.items() if n >= min_rows and p not in set(shares) and (only is None or p in only))
    column = {p: i for i, p in enumerate([*words, *shares])}
    at, col, val = [], [], []
    for i, r in enumerate(rows):
        ws = [column[p] for p in set(r["words"]) if p in column]
        ss = [(column[p], v) for p, v in zip(r["places"], r["shares"]) if p in column]
        at += [i] * (len(ws) + len(ss))
        col += [*ws, *(p for p, _ in ss)]
        val += [*[1.0] * len(ws), *(v for _, v in ss)]
    at, col, val = np.array(at, int), np.array(col, int), np.array(val, float)
    n, d = len(y), len(column)
    counts = np.bincount(y, minlength=grades)
    weight = (n / (counts.clip(1) ** 0.5))[y]  # between the classes' own frequency and equal shares
    weight /= weight.sum()
    scale = np.ones(d)  # shares are rare but plain signs; words are many
    scale[len(words) :] = 10.0
    penalty = np.where(np.arange(d) < len(words), l1, l1 / 20)
    w, first, gaps = np.zeros(d), -1.0, np.ones(grades - 2)
    g2, gt2 = np.full(d, 1e-8), np.full(grades - 1, 1e-8)
    for step in range(steps):
        score = np.bincount(at, weights=val * scale[col] * w[col], minlength=n)
        cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
        below = np.concatenate([np.zeros((n, 1)), _sigmoid(cuts[None, :] - score[:, None]), np.ones((n, 1))], axis=1)
        up, low = below[np.arange(n), y + 1], below[np.arange(n), y]
        mass = np.maximum(up - low, 1e-9)
        dup, dlow = up * (1 - up), low * (1 - low)
        dscore = weight * (dup - dlow) / mass  # of the negative log likelihood
        grad = np.bincount(col, weights=val * scale[col] * dscore[at], minlength=d) + l2 * w
        dcut = np.zeros(grades - 1)
        np.add.at(dcut, y[y < grades - 1], -(weight * dup / mass)[y < grades - 1])
        np.add.at(dcut, y[y > 0] - 1, (weight * dlow / mass)[y > 0])
        g2 = 0.95 * g2 + 0.05 * grad**2
        rate = 0.05 / (1 + step / 100)
        move = rate / (np.sqrt(g2) + 1e-4)
        w = w - move * grad
        w = np.sign(w) * np.maximum(np.abs(w) - move * penalty, 0)
        dpar = np.array([dcut.sum(), *(dcut[k:].sum() for k in range(1, grades - 1))])
        gt2 = 0.95 * gt2 + 0.05 * dpar**2
        moved = np.array([first, *gaps]) - rate * dpar / (np.sqrt(gt2) + 1e-4)
        first, gaps = moved[0], np.maximum(moved[1:], 0.0)
    cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
    places = [*words, *shares]
    return Model({p: float(w[i] * scale[i]) for i, p in enumerate(places) if w[i]}, [float(c) for c in cuts])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """The sample is gathered on the driver: at most ``max_rows`` documents' features."""
    return fit([r.asDict() for r in training_rows(docs, labels, id_col, text_col, max_rows).toLocalIterator()])


def _scores(docs: DataFrame, model: Model, key, text_col: str) -> DataFrame:
    rows = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches):
        own = Model(*sent.value)
        score = own.scorer()
        for batch in batches:
            tails = [own.tails(score(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([sum(t) for t in tails], pa.float64()), pa.array([t[-1] for t in tails], pa.float64())], names=["key", "expected_grade", "tail_probability"])

    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())])
    return map_arrow(rows, run, schema)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row: id, expected_grade, tail_probability, selected."""
    told = _scores(docs, model, F.col(id_col), text_col)
    return told.select(F.col("key").alias(id_col), "expected_grade", "tail_probability", (F.col("tail_probability") >= threshold).alias("selected"))


def select_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows and columns of selected documents, in one pass and without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    place = docs.columns.index(text_col)

    def run(batches):
        own = Model(*sent.value)
        score = own.scorer()
        for batch in batches:
            yield batch.filter(pa.array([own.tails(score(t.as_py()))[-1] >= threshold for t in batch.column(place)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
