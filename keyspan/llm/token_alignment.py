"""Alignment of the tokens of two vocabularies over the same bytes (operator 12).

A text's tokens end at byte offsets, one rising array per vocabulary. Where both arrays have an offset, a group of tokens ends. The
arrays are compared along a diagonal, the current shift of one index against the other: windows of 1, 2, 4, ... ends are compared as
wholes for as long as they agree, and the window that differs is halved until the first difference, so a stretch of one-to-one tokens
costs its logarithm in comparisons. From there the nearer end is advanced until both meet again: that group is irregular, and its
length is the new shift.

Two tokens are linked where their bytes overlap. How many documents hold a pair of ids linked is counted over the whole corpus, and every
document is told how well its links fit those counts. Links of a document are written once as distinct pairs with their number, so nothing is
encoded twice. The counts of the commonest ``HOT`` pairs at most travel to the tasks as two sorted arrays; links of rarer pairs are joined
with the table of counts.

Defined cases: a null or empty text, and one that either vocabulary does not give back byte by byte after a space, has no tokens, all its
numbers are zero and its digest is the empty text. Strings of special tokens are plain text. Rows that share an id, or have none, are
rows of their own. Ties for the highest count all count as best. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.staging import staged
from keyspan.llm.vocabularies import ByteVocabulary, PieceVocabulary, batches_of, byte_vocabulary, piece_vocabulary
from keyspan.operators.frames import quoted

# Pairs whose counts every task gets: 16 bytes each.
HOT = 1 << 20
# A pair of ids as one number: the second id is below this.
BASE = 1 << 31
# Texts and characters aligned at once.
AT_ONCE, CHARS_AT_ONCE = 256, 400_000

NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def align(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int], list[int], list[int], list[int], list[int]]:
    """One-to-one stretches as first index of the first side and length; irregular groups as first and last-but-one indices of both.

    Both lists rise and end with the same offset. In the order they are found: ``stretch, length, from_a, from_b, until_a, until_b``.
    """
    n = len(ends_a)
    # A mark behind the last end, so that the step beyond it can look.
    ends_a, ends_b = [*ends_a, -1], [*ends_b, -1]
    stretch, length, from_a, from_b, until_a, until_b = [], [], [], [], [], []
    i = j = 0
    while i < n:
        x, y = ends_a[i], ends_b[j]
        if x == y:
            start = i
            i, j, width = i + 1, j + 1, 1
            # Both marks agree as well, so a window that reaches them holds the rest of both sides.
            while i < n and ends_a[i : i + width] == ends_b[j : j + width]:
                i, j, width = i + width, j + width, 2 * width
            while i < n and width > 1:
                width //= 2
                if ends_a[i : i + width] == ends_b[j : j + width]:
                    i, j = i + width, j + width
            stretch.append(start)
            length.append(min(i, n) - start)
        else:
            from_a.append(i)
            from_b.append(j)
            while x != y:
                if x < y:
                    i += 1
                    x = ends_a[i]
                else:
                    j += 1
                    y = ends_b[j]
            i, j = i + 1, j + 1
            until_a.append(i)
            until_b.append(j)
    return stretch, length, from_a, from_b, until_a, until_b


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of every stretch, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def groups_and_links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The groups' ends as indices into either array, and the linked tokens as two arrays of indices, one-to-one groups first."""
    found = align(ends_a.tolist(), ends_b.tolist())
    stretch, length, from_a, from_b, until_a, until_b = (np.array(part, np.int64) for part in found)
    own_a, own_b = _spread(from_a, until_a - from_a), _spread(from_b, until_b - from_b)
    # Where a stretch begins on the second side: the shift left by the irregular groups before it.
    shift = np.concatenate([[0], until_b - until_a])[np.searchsorted(from_a, stretch)]
    one_a, one_b = _spread(stretch, length), _spread(stretch + shift, length)
    # Within irregular groups every offset where either side ends closes the overlap of one pair of tokens.
    offsets = np.union1d(ends_a[own_a], ends_b[own_b])
    link_a, link_b = own_a[np.searchsorted(ends_a[own_a], offsets)], own_b[np.searchsorted(ends_b[own_b], offsets)]
    # Groups are disjoint and in the same order on both sides.
    all_a, all_b = np.sort(np.concatenate([one_a + 1, until_a])), np.sort(np.concatenate([one_b + 1, until_b]))
    return all_a, all_b, np.concatenate([one_a, link_a]), np.concatenate([one_b, link_b])


class Aligner:
    """Two vocabularies; ``tokens`` gives the ids of a text in both, ``rows`` what is to be known of many texts."""

    def __init__(self, a: ByteVocabulary, b: PieceVocabulary):
        self.a, self.b = a, b
        # Every id with what may follow it in a listed group: a comma, the bar between both sides, the end of the group.
        self.listed = [f"{k}{mark}" for k in range(max(len(a.table), len(b.table))) for mark in ",|;"]

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        found = []
        for text, right in zip(texts, self.b.encode(texts), strict=True):
            left = self.a.encode(" " + text) if text else []
            raw = b" " + text.encode("utf-8", "surrogatepass")
            # Bytes of the second side can differ; those of the first are the text's own, whatever the text is.
            same = bool(left) and raw == b"".join(map(self.b.table.__getitem__, right))
            found.append((left, right) if same else ([], []))
        return found

    def rows(self, texts: list[str]) -> dict[str, pa.Array]:
        """A column each of ``NUMBERS``, ``groups_sha256``, ``pairs`` and ``times``: distinct pairs of ids and their links."""
        tokens = self.tokens(texts)
        n_a = np.array([len(left) for left, _ in tokens], np.int64)
        n_b = np.array([len(right) for _, right in tokens], np.int64)
        ids_a = np.fromiter(chain.from_iterable(left for left, _ in tokens), np.int64, n_a.sum())
        ids_b = np.fromiter(chain.from_iterable(right for _, right in tokens), np.int64, n_b.sum())
        # All texts as one: each ends where both its sides do, so no group crosses from one to the next.
        group_a, group_b, link_a, link_b = groups_and_links(np.cumsum(self.a.sizes[ids_a]), np.cumsum(self.b.sizes[ids_b]))
        until_a, until_b = np.cumsum(n_a), np.cumsum(n_b)
        until_group = np.searchsorted(group_a, until_a, "right")
        owner = np.searchsorted(until_a, link_a, "right")
        pairs, times, pairs_until = self._pairs(owner, ids_a[link_a] * BASE + ids_b[link_b], len(texts))
        listed = self._listed(ids_a, ids_b, group_a, group_b)
        digests, start = [], 0
        for end in (until_a + until_b).tolist():
            digests.append(hashlib.sha256("".join(map(self.listed.__getitem__, listed[start:end]))[:-1].encode()).hexdigest() if end > start else "")
            start = end
        return {
            "n_a": pa.array(n_a),
            "n_b": pa.array(n_b),
            "n_groups": pa.array(np.diff(until_group, prepend=0)),
            "n_links": pa.array(np.bincount(owner, minlength=len(texts))),
            "groups_sha256": pa.array(digests, pa.string()),
            "pairs": pa.ListArray.from_arrays(pa.array(pairs_until, pa.int32()), pa.array(pairs)),
            "times": pa.ListArray.from_arrays(pa.array(pairs_until, pa.int32()), pa.array(times, pa.int32())),
        }

    @staticmethod
    def _pairs(owner: np.ndarray, pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((pairs, owner))
        owner, pairs = owner[order], pairs[order]
        first = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])])) if len(pairs) else np.array([], np.int64)
        times = np.diff(np.append(first, len(pairs)))
        until = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=n))])
        return pairs[first], times, until

    @staticmethod
    def _listed(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[int]:
        """Places in ``self.listed``, group by group, first side before second."""
        sizes_a, sizes_b = np.diff(group_a, prepend=0), np.diff(group_b, prepend=0)
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        code_a, code_b = ids_a * 3, ids_b * 3
        code_a[group_a - 1] += 1
        code_b[group_b - 1] += 2
        out[np.arange(len(ids_a)) + np.repeat(group_b - sizes_b, sizes_a)] = code_a
        out[np.arange(len(ids_b)) + np.repeat(group_a, sizes_b)] = code_b
        return out.tolist()


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, row, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times`` per row of ``docs``."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), quoted(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{name} long" for name in NUMBERS)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_vocabulary(path_a), piece_vocabulary(path_b))
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for start, end in batches_of(texts, AT_ONCE, CHARS_AT_ONCE):
                part, columns = batch.slice(start, end - start), aligner.rows(texts[start:end])
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["row"], *columns.values()], names=["doc_id", "row", *columns])

    return rows.mapInArrow(of_batches, f"doc_id {id_type}, row long, {numbers}, groups_sha256 string, pairs array<bigint>, times array<int>")


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair, a, n``: in how many rows of ``aligned`` each pair of ids is linked."""
    each = found.select(F.explode("pairs").alias("pair"))
    return each.groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.expr(f"pair div {BASE}"))


def least_hot(counts: DataFrame, hot: int) -> int:
    """The least count such that at most ``hot`` pairs have it or a higher one; counts are told apart to an eighth of a power of two."""
    step = F.floor(8 * F.log2(F.col("n").cast("double")))
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()
    least, total = 1 << 62, 0
    for size in sorted(sizes, key=lambda s: -s["step"]):
        total += size["pairs"]
        if total > hot:
            break
        least = size["least"]
    return least


def score_alignment(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row of ``docs``.

    ``n_best`` counts the links whose pair has the highest count of its first id, ``count_sum`` adds the counts of all links.
    """
    found = staged(aligned(docs, path_a, path_b, doc_id, text))
    counts = staged(pair_counts(found))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    least = least_hot(counts, hot)
    common = counts.where(F.col("n") >= least).select("pair", "n").toArrow().sort_by("pair")
    # One row per id of the first vocabulary at most.
    best = highest.toArrow()
    by_id = np.zeros(max(best["a"].to_pylist(), default=0) + 1, np.int64)
    by_id[best["a"].to_numpy()] = best["highest"].to_numpy()
    known = found.sparkSession.sparkContext.broadcast((common["pair"].to_numpy(), common["n"].to_numpy(), by_id))
    scored = found.mapInArrow(
        lambda batches: _scored(batches, known.value),
        ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name not in ("pairs", "times"))
        + ", n_best long, count_sum long, rare array<bigint>, rare_times array<int>",
    )
    columns = ["doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"]
    rare = counts.where(F.col("n") < least)
    if rare.isEmpty():
        return scored.select(*columns)
    scored = staged(scored)
    left = scored.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("link")).select("row", F.col("link.rare").alias("pair"), "link.rare_times")
    sums = left.join(rare, "pair").join(highest, "a").groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("highest"), F.col("rare_times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("n") * F.col("rare_times")).alias("more_sum"),
    )

    def added(name: str, more: str) -> Column:
        return (F.col(name) + F.coalesce(more, F.lit(0))).alias(name)

    joined = scored.join(sums, "row", "left").withColumns({"n_best": added("n_best", "more_best"), "count_sum": added("count_sum", "more_sum")})
    return joined.select(*columns)


def _scored(batches: Iterator[pa.RecordBatch], known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    keys, counts, highest = known
    for batch in batches:
        lists = batch["pairs"]
        until = lists.offsets.to_numpy().astype(np.int64)
        until = until - until[0]
        pairs, times = lists.flatten().to_numpy(), batch["times"].flatten().to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
        n = np.where(hit, counts[at] if len(keys) else 0, 0)
        best = np.where(hit & (n == highest[pairs // BASE]), times, 0)

        def per_row(values: np.ndarray, until=until) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(values)])[until])

        misses = pa.array(np.concatenate([[0], np.cumsum(per_row(~hit))]), pa.int32())
        rest = [batch[name] for name in batch.schema.names if name not in ("pairs", "times")]
        names = [name for name in batch.schema.names if name not in ("pairs", "times")]
        columns = [
            pa.array(per_row(best)),
            pa.array(per_row(n * times)),
            pa.ListArray.from_arrays(misses, pa.array(pairs[~hit], pa.int64())),
            pa.ListArray.from_arrays(misses, pa.array(times[~hit], pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays([*rest, *columns], names=[*names, "n_best", "count_sum", "rare", "rare_times"])
