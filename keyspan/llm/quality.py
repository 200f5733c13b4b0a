"""Quality classifier: a generalised additive model with pairwise interactions (operator 2).

A text's score is the logistic function of a sum: one number for each feature, read from a table by the feature's bin,
and one for each chosen pair of features, read from a table of two bins. Shallow trees on the bins learn the tables by
cyclic gradient boosting, one feature after the other in every round, then the pairs that explain most of what is
left. Scoring is a vectorised sum over tables.

Training is bounded: ``TRAIN_ROWS`` labelled rows at most, about, chosen by a hash of their id, and never a row with
``crc32(id) mod 3 = 1``. Features are computed and texts are scored by all tasks; only the sample's numbers and the
tables pass through the driver.

Defined cases: null and empty texts have zeros for features and get a score like any other. Null labels and documents
with labels that contradict each other are not learned from; rows repeating a label count once. Without labelled rows
every score is 0.5. Rows with a null id are not held out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.operators.frames import quoted

TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE = 60, 30, 0.3
# Added to a leaf's weight: small leaves move little.
SHRINK = 2.0

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes(range(ord("a"), ord("z") + 1))
_DIGITS = b"0123456789"
_ENDS = b".,;:?"
_SYMBOLS = b"#$%&*+/<=>@\\^_`{|}~"
FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "lower", "digits", "ends", "symbols", "shouts", "wide",
    "distinct_words", "top_word", "repeated_lines", "words_per_line", "repeated_pairs", "odd_words", "capital_words",
)
_DROPPED = [(x, None) for x in (_UPPER, _LOWER, _DIGITS, _ENDS, _SYMBOLS, b"!", bytes(range(128, 256)))]


def text_features(text: str | None) -> list[float]:
    """Numbers in the order of :data:`FEATURES`; shares of bytes, words or lines, but for the first three and ``words_per_line``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    shares = [(size - len(raw.translate(None, chars))) / size for chars, _ in _DROPPED]
    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    pairs = set(zip(words, words[1:], strict=False))
    plain = raw.translate(None, _SYMBOLS + b"!")
    odd = 1 - len(plain.split()) / n
    marked = sum(1 for w in counts if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in (b".", b",")) / len(counts)
    capital = sum(c for w, c in counts.items() if w[0] in _UPPER) / n
    return [
        np.log1p(size), np.log1p(n), (size - n + 1) / n, *shares,
        len(counts) / n, max(counts.values()) / n, 1 - len(set(lines)) / len(lines), n / len(lines),
        1 - len(pairs) / (n - 1) if n > 1 else 0.0, max(odd, marked), capital,
    ]


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([text_features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class AdditiveModel:
    """``edges`` cut a feature into bins; ``tables`` has a number per bin, ``pair_tables`` a square of numbers per pair of features."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], side="right")]
        if self.pair_tables:
            bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.pair_edges)]
            for (a, b), table in self.pair_tables.items():
                total += table[bins[a], bins[b]]
        return 1 / (1 + np.exp(-total))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Edges at quantiles of the values, fewer where values repeat."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.array([])


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values per bin of a tree over ordered bins with sums ``g`` of gradients and ``h`` of curvatures."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    if depth and len(g) > 1:
        gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
        cut = int(gains.argmax()) + 1
        if gains[cut - 1] > 1e-9:
            return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])
    return np.full(len(g), all_g / (all_h + SHRINK))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and the leaf values of the best cross of one cut per axis, over squares of sums."""
    (rows, columns), best = g.shape, (0.0, np.zeros_like(g))
    cum_g, cum_h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    for i in range(1, rows):
        for j in range(1, columns):
            corners = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
            sums = []
            for s in (cum_g, cum_h):
                a, b, c, d = s[i, j], s[i, -1], s[-1, j], s[-1, -1]
                sums.append(np.array([a, b - a, c - a, d - b - c + a]))
            gain = float(_gain(*sums).sum())
            if gain > best[0]:
                values = np.zeros_like(g)
                for where, value in zip(corners, sums[0] / (sums[1] + SHRINK), strict=True):
                    values[where] = value
                best = gain, values
    return best


def fit_additive(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of the logistic loss: trees of two levels per feature, then crosses on the strongest pairs."""
    if not len(y):
        return AdditiveModel()
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(start=float(np.log(share / (1 - share))))
    model.edges = [_cuts(x[:, k], BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    total = np.full(len(y), model.start)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, own in enumerate(bins):
            g, h = gradients()
            n = len(model.tables[k])
            step = RATE * _tree(np.bincount(own, g, n), np.bincount(own, h, n), 2)
            model.tables[k] += step
            total += step[own]
    model.pair_edges = [_cuts(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    sizes = [len(e) + 1 for e in model.pair_edges]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.pair_edges)]

    def square(a: int, b: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * sizes[b] + coarse[b], values, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = gradients()
    strength = {(a, b): _quadrants(square(a, b, g), square(a, b, h))[0] for a, b in combinations(range(x.shape[1]), 2)}
    for pair in sorted(strength, key=lambda p: (-strength[p], p))[:PAIRS]:
        model.pair_tables[pair] = np.zeros((sizes[pair[0]], sizes[pair[1]]))
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in model.pair_tables.items():
            g, h = gradients()
            step = RATE * _quadrants(square(a, b, g), square(a, b, h))[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS
) -> AdditiveModel:
    """The model of the labelled documents that are not held out, from about ``rows`` of them at most."""
    known = (
        labels.select(quoted(doc_id).alias("doc_id"), quoted(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .drop("most")
    )
    share = min(1.0, rows / max(1, known.count()))
    # Below a share of all hashes: the bound holds up to chance, and the sample is the same each time.
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")).join(F.broadcast(sample), "doc_id")
    # One text per id, however often an id is repeated.
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _matrix(batch["text"].to_pylist()).T
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], *map(pa.array, columns)], names=["doc_id", "label", *FEATURES])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, label int, " + ", ".join(f"{f} double" for f in FEATURES)
    learned = texts.select("doc_id", "text", "label").mapInArrow(features, schema).toPandas().sort_values(["doc_id", *FEATURES])
    return fit_additive(learned[list(FEATURES)].to_numpy(np.float64), learned["label"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: AdditiveModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(_matrix(batch["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found)], names=["doc_id", "score"])

    scored = rows.mapInArrow(scores, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AdditiveModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, all columns as they are."""

    # Plain names: those of the columns may have dots.
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    place = docs.columns.index(text)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(_matrix(batch.column(place).to_pylist()))
            yield batch.filter(pa.array(found >= 0.5))

    return plain.mapInArrow(good, plain.schema).toDF(*docs.columns)
