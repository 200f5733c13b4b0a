"""Forests and boosted trees of all keys, settings and folds grown together, one aggregation per level.

Rows are packed once into blocks of consecutive rows of a key, with their values as bins. At every level each block meets the unfinished
trees of its key, walks its rows to their nodes and adds them up per node, feature and bin; the sums of all blocks of a tree are added
and its best splits chosen. Keys of up to ``ALONE_VALUES`` values don't need that: their blocks meet in a task, which
grows their trees, by the same steps, from the first level to the last. The number of jobs depends on depth and on the number of boosting steps, not on keys, settings or folds,
and a key's rows are spread over as many tasks as they fill. What the next level needs, the trees so far, is a table with a row per
tree; the driver sees none of it.

Rows of a key with equal features are alike to every tree. In tables of more than ``CELL_ROWS`` rows they are one cell, a weighted row with
their number, mean label and spread; those in training, in a sample and in each fold are cells apart, and where settings sample rows a cell has
the sums of each sample. Spark groups them before anything else, so what is grown grows with the different rows, not with all of them.

What settings share is grown once: a forest with a smaller ``maxDepth`` is the upper part of the deeper one, boosting with fewer steps
the beginning of the longer one.

As in Spark ML: splits lie halfway between values, or near quantiles where a feature has more values than bins; variance decides, the
first of equal splits wins; ``minWeightFractionPerNode`` counts all training rows, before sampling; a forest of one tree looks at
all features, of more at a third of them per node; boosting adds a first tree in full and the others by ``stepSize``. Bins are those of
the key's training rows, for all its folds. Draws hang on hashes of the row id, so results don't depend on the layout.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.functions.sampling import HASH_RANGE, id_hash
from keyspan.models.cells import CELL_ROWS, ROWS, cells
from keyspan.models.cells import SPREAD as SPREAD_OF_LABELS
from keyspan.models.trees import DRAWS, TIE, rows_of_keys
from keyspan.operators.frames import drop_incomplete, quoted
from keyspan.sources.storage import written

# Rows of a block, values a sketch of a feature keeps, partial sums one task adds.
BLOCK = 8192
SKETCH = 4096
FAN_IN = 64
# Keys whose sums a worker holds at once.
HELD = 2
# Values (rows by features) of a key up to which one task grows its trees from the first level to the last.
ALONE_VALUES = 2_000_000
# Tasks that small keys are spread over while there are few of them.
SPREAD = 32
# Samples of rows (trees by rates) up to which rows are grouped into cells.
CELL_SAMPLES = 16
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Settings:
    """What one ensemble of a key is grown with. ``fold`` is the one left out for scoring, -1 for none of them."""

    boosted: bool = False
    trees: int = 1
    max_depth: int = 5
    max_bins: int = 32
    min_rows: int = 1
    min_weight: float = 0.0
    min_gain: float = 0.0
    rate: float = 1.0
    bootstrap: bool = True
    subset: str = "auto"
    step: float = 0.1
    folds: int = 1
    fold: int = -1
    train_split: float = 0.8
    fraction: float = 1.0
    seed: int = 1

    @classmethod
    def of(cls, kind: str, params: dict, **more) -> Settings:
        """From Spark ML parameters; those that only other estimators have are refused by name."""
        boosted = kind == "gradient_boost"
        if params.get("impurity", "variance") != "variance" or params.get("lossType", "squared") != "squared":
            raise ValueError("trees of all keys are grown by variance and squared loss")
        names = {
            "numTrees": "trees", "maxIter": "trees", "maxDepth": "max_depth", "maxBins": "max_bins", "minInstancesPerNode": "min_rows",
            "minWeightFractionPerNode": "min_weight", "minInfoGain": "min_gain", "subsamplingRate": "rate", "bootstrap": "bootstrap",
            "featureSubsetStrategy": "subset", "stepSize": "step", "train_split": "train_split",
        }
        own = {names[k]: v for k, v in params.items() if k not in ("impurity", "lossType")}
        if boosted:
            own = {"trees": 20, "bootstrap": False, "subset": "all"} | own
        return cls(boosted=boosted, **(own | more))

    def features_per_node(self, n: int) -> int:
        kind = self.subset.lower()
        if kind == "auto":
            kind = "all" if self.trees == 1 else "onethird"
        if kind == "all":
            return n
        if kind in ("onethird", "sqrt", "log2"):
            return max(1, math.ceil({"onethird": n / 3, "sqrt": math.sqrt(n), "log2": math.log2(n)}[kind]))
        number = float(kind)
        return max(1, min(n, math.ceil(number * n) if "." in kind else int(number)))


@dataclass
class Tree:
    """Nodes as arrays: ``feature`` (-1 at a leaf), the last bin that goes left, the left child (the right one follows), mean and weight."""

    feature: np.ndarray = field(default_factory=lambda: np.array([-1], np.int16))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    child: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(1))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(1))
    rows: float = 0.0  # training rows before sampling
    depth: int = 0
    open: np.ndarray = field(default_factory=lambda: np.array([0], np.int64))

    def levels(self) -> list[int]:
        """Steps from the root to every node."""
        level = [0] * len(self.feature)
        for node in np.flatnonzero(self.feature >= 0).tolist():
            level[self.child[node]] = level[self.child[node] + 1] = level[node] + 1
        return level

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of every row (a column of ``bins``) after at most ``depth`` steps."""
        at = np.zeros(bins.shape[1], np.int64)
        every = np.arange(bins.shape[1])
        for _ in range(min(depth, self.depth)):
            feature = self.feature[at]
            inner = feature >= 0
            at = np.where(inner, self.child[at] + (bins[feature * inner, every] > self.cut[at]), at)
        return at


# Rows, packed


def _sample(s: Settings, tree: int) -> tuple | None:
    """What decides how often a tree's rows are drawn, None where each is drawn once."""
    return None if not s.bootstrap and s.rate >= 1 else (s.rate, s.bootstrap, s.seed, 0 if s.boosted and s.rate >= 1 else tree)


def samples_of(tasks: list[Settings]) -> dict[tuple, tuple[Settings, int]]:
    """The samples of all tasks' trees, each with a setting and a tree that draw it."""
    return {own: (s, tree) for s in tasks for tree in range(s.trees) if (own := _sample(s, tree)) is not None}


def sampled_cells(rows: DataFrame, features: list[str], tasks: list[Settings]) -> DataFrame:
    """``rows`` (key, draws, features, ``_y``) with those that no task tells apart as one: ``_n, _m2`` are their number and the sum of squares
    about their mean ``_y``, ``_w0, _wy0, ...`` how often each sample draws them, and the drawn labels' sum. Draws are one of them each."""
    drawn = list(samples_of(tasks).values())
    if drawn:
        draws = [f"_{purpose}" for purpose in DRAWS]

        def with_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = np.stack([batch[c].to_numpy() for c in draws])
                for i, (s, tree) in enumerate(drawn):
                    batch = batch.append_column(f"_w{i}", pa.array(_times(own, s, tree)))
                yield batch

        columns = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + [f"_w{i} double" for i in range(len(drawn))])
        rows = rows.mapInArrow(with_samples, columns)
    sums = [c for i in range(len(drawn)) for c in (F.sum(f"_w{i}").alias(f"_w{i}"), F.sum(F.col(f"_w{i}") * F.col("_y")).alias(f"_wy{i}"))]
    by = [F.col(c) for c in ("key", *features)]
    return cells(rows, by, "_y", [f"_{purpose}" for purpose in DRAWS], tasks[0].train_split, [s.fraction for s in tasks], [s.folds for s in tasks if s.fold >= 0], sums)


def pack(
    df: DataFrame,
    key: str,
    features: list[str],
    label: str,
    row_id: str | list[str],
    keys: list | DataFrame | None = None,
    seed: int = 1,
    tasks: list[Settings] | None = None,
) -> DataFrame:
    """Blocks ``key, n, x, y, draws, sums``: complete rows of the wanted keys, features one after the other, as bytes; ``sums`` are those of
    ``sampled_cells`` where the ``tasks`` are given and the rows are many, else null."""
    if not features:
        raise ValueError("a tree model needs at least one feature")
    rows = rows_of_keys(df, key, keys).select(
        quoted(key).alias("key"),
        *[id_hash(row_id, purpose, seed).alias(f"_{purpose}") for purpose in DRAWS],
        *[quoted(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)],
        quoted(label).cast("double").alias("_y"),
    )
    inputs, draws = [f"_f{i}" for i in range(len(features))], [f"_{purpose}" for purpose in DRAWS]
    rows = drop_incomplete(rows, ["key", *inputs, "_y"])
    sums: list[str] = []
    if tasks and len(samples_of(tasks)) <= CELL_SAMPLES and rows.count() > CELL_ROWS:
        rows = sampled_cells(rows, inputs, tasks)
        sums = [ROWS, SPREAD_OF_LABELS, *[f"_{kind}{i}" for i in range(len(samples_of(tasks))) for kind in ("w", "wy")]]
    rows = rows.hint("rebalance", "key").sortWithinPartitions("key", *draws, *inputs)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            x = np.stack([table[c].to_numpy() for c in inputs])
            d = np.stack([table[c].to_numpy() for c in draws])
            own = np.stack([table[c].to_numpy() for c in sums]).tobytes() if sums else None
            row = [waiting[0]["key"].slice(0, 1), pa.array([table.num_rows]), pa.array([x.tobytes()]), pa.array([table["_y"].to_numpy().tobytes()]), pa.array([d.tobytes()])]
            waiting.clear()
            return pa.RecordBatch.from_arrays([*row, pa.array([own], pa.binary())], names=["key", "n", "x", "y", "draws", "sums"])

        for batch in batches:
            codes = batch["key"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
            for start, end in zip(bounds, bounds[1:]):
                if start == end:
                    continue
                if waiting and waiting[0]["key"][0] != batch["key"][start]:
                    yield packed()
                while start < end:
                    take = min(end - start, BLOCK - sum(b.num_rows for b in waiting))
                    waiting.append(batch.slice(start, take))
                    start += take
                    if sum(b.num_rows for b in waiting) == BLOCK:
                        yield packed()
        if waiting:
            yield packed()

    kind = rows.schema["key"].dataType.simpleString()
    return written(rows.mapInArrow(blocks, f"key {kind}, n long, x binary, y binary, draws binary, sums binary"))


def _block(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, draws and sums of a block; rows that are no cells count once and have no spread."""
    y = np.frombuffer(batch["y"][i].as_py())
    own = batch["sums"][i].as_py()
    sums = np.stack([np.ones(len(y)), np.zeros(len(y))]) if own is None else np.frombuffer(own).reshape(-1, len(y))
    return y, np.frombuffer(batch["draws"][i].as_py(), np.int64).reshape(len(DRAWS), -1), sums


# Bins


@dataclass
class Sketch:
    """Values of a feature with their number of rows; exact up to ``SKETCH`` different ones, then evenly spaced ranks."""

    values: np.ndarray
    counts: np.ndarray
    exact: bool = True

    def plus(self, other: Sketch) -> Sketch:
        values, where = np.unique(np.concatenate([self.values, other.values]), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([self.counts, other.counts]), minlength=len(values))
        if len(values) <= SKETCH:
            return Sketch(values, counts, self.exact and other.exact)
        edges = np.searchsorted(np.cumsum(counts), np.linspace(0, counts.sum(), SKETCH + 1)[1:])
        edges = np.unique(np.minimum(edges, len(values) - 1))
        sums = np.add.reduceat(counts, np.concatenate([[0], edges[:-1] + 1]))
        return Sketch(values[edges], sums, False)

    def cuts(self, bins: int) -> np.ndarray:
        """Thresholds between bins: halfway between neighbours, where there are more values than bins those next to even shares."""
        middles = (self.values[:-1] + self.values[1:]) / 2
        if len(middles) < bins:
            return middles
        below = np.cumsum(self.counts)[:-1]
        wanted = self.counts.sum() * np.arange(1, bins) / bins
        at = np.minimum(np.searchsorted(below, wanted), len(below) - 1)
        nearer = (at > 0) & (wanted - below[at - 1] <= below[at] - wanted)
        return middles[np.unique(at - nearer)]


def bin_cuts(packed: DataFrame, n_features: int, max_bins: list[int], train_split: float) -> DataFrame:
    """``key, cuts``: thresholds per number of bins and feature, and the mean label, from the training rows of every key."""

    def added(rows: Iterable[tuple], most: int | None = None) -> Iterator[tuple]:
        held: dict = {}
        for key, *parts in rows:
            if most and key not in held and len(held) == most:
                yield held.popitem()
            held[key] = parts if key not in held else [held[key][0] + parts[0], held[key][1] + parts[1], [a.plus(b) for a, b in zip(held[key][2], parts[2])]]
        yield from held.items()

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for i in range(batch.num_rows):
                    y, draws, sums = _block(batch, i)
                    train = draws[0] < train_split * HASH_RANGE
                    x = np.frombuffer(batch["x"][i].as_py()).reshape(n_features, -1)[:, train]
                    rows = sums[0, train]
                    sketches = [Sketch(np.array([]), np.array([])).plus(Sketch(own, rows)) for own in x]
                    yield batch["key"][i].as_py(), int(rows.sum()), float((rows * y[train]).sum()), sketches

        for key, found in added(parts(), HELD):
            yield pa.RecordBatch.from_arrays([pa.array([key], key_type), pa.array([pickle.dumps(found)])], names=["key", "part"])

    def together(table: pa.Table) -> tuple:
        key = table["key"][0].as_py()
        return next(added((key, *pickle.loads(part.as_py())) for part in table["part"]))

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"key": table["key"].slice(0, 1), "part": pa.array([pickle.dumps(together(table)[1])])})

    def chosen(table: pa.Table) -> pa.Table:
        n, total, sketches = together(table)[1]
        cuts = {bins: [s.cuts(max(2, min(bins, n))) if n else s.values for s in sketches] for bins in max_bins}
        return pa.table({"key": table["key"].slice(0, 1), "cuts": pa.array([pickle.dumps((cuts, total / max(n, 1)))])})

    kind = packed.schema["key"].dataType.simpleString()
    key_type = _arrow_type(packed, "key")
    parts = packed.mapInArrow(of_blocks, f"key {kind}, part binary")
    slots = parts.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(FAN_IN))).groupBy("key", "slot").applyInArrow(merged, f"key {kind}, part binary")
    return written(slots.groupBy("key").applyInArrow(chosen, f"key {kind}, cuts binary"))


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def binned(packed: DataFrame, cuts: DataFrame, n_features: int) -> DataFrame:
    """Blocks ``key, n, y, draws, sums, bins`` (per number of bins), and ``pred`` for boosting; labels less their key's mean. The labels that
    the samples of a cell draw are means here, too."""

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of_bins, mean = pickle.loads(batch["cuts"][i].as_py())
                x = np.frombuffer(batch["x"][i].as_py()).reshape(n_features, -1)
                bins = {b: np.stack([np.searchsorted(c, own).astype(np.uint16) for c, own in zip(cuts, x)]) for b, cuts in of_bins.items()}
                y = np.frombuffer(batch["y"][i].as_py()) - mean
                sums = batch["sums"].slice(i, 1)
                if sums[0].is_valid:
                    own = np.frombuffer(sums[0].as_py()).reshape(-1, len(y)).copy()
                    own[3::2] = np.where(own[2::2] > 0, own[3::2] / np.maximum(own[2::2], 1.0) - mean, 0.0)
                    sums = pa.array([own.tobytes()])
                row = [batch["key"].slice(i, 1), batch["n"].slice(i, 1), pa.array([y.tobytes()]), batch["draws"].slice(i, 1), sums, pa.array([pickle.dumps(bins)])]
                yield pa.RecordBatch.from_arrays([*row, pa.nulls(1, pa.binary()), pa.array([[]], pa.list_(ERRORS))], names=BLOCKS)

    kind = packed.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n long, y binary, draws binary, sums binary, bins binary, pred binary, errors {ERRORS_SQL}"
    return written(packed.join(cuts, "key").mapInArrow(of_blocks, schema))


BLOCKS = ["key", "n", "y", "draws", "sums", "bins", "pred", "errors"]


ERRORS = pa.struct([("task", pa.int32()), ("depth", pa.int32()), ("stage", pa.int32()), ("n", pa.int64()), ("sse", pa.float64()), ("sy", pa.float64()), ("syy", pa.float64())])
ERRORS_SQL = "array<struct<task:int,depth:int,stage:int,n:bigint,sse:double,sy:double,syy:double>>"


def _mixed(draws: np.ndarray, number: int) -> np.ndarray:
    """Draws in [0, 1) per row and number, unrelated to what the row's draws decide alone."""
    with np.errstate(over="ignore"):
        z = draws[0].astype(np.uint64) << np.uint64(32) ^ draws[1].astype(np.uint64) ^ draws[2].astype(np.uint64) << np.uint64(16)
        z += np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(31)) >> np.uint64(11)).astype(float) * 2.0**-53


def _in_training(draws: np.ndarray, s: Settings) -> np.ndarray:
    inside = (draws[0] < s.train_split * HASH_RANGE) & (draws[1] < s.fraction * HASH_RANGE)
    return inside & (draws[2] % s.folds != s.fold) if s.fold >= 0 else inside


def _held_out(draws: np.ndarray, s: Settings) -> np.ndarray:
    within = draws[1] < s.fraction * HASH_RANGE
    if s.fold >= 0:
        return within & (draws[0] < s.train_split * HASH_RANGE) & (draws[2] % s.folds == s.fold)
    return within & (draws[0] >= s.train_split * HASH_RANGE)


def _times(draws: np.ndarray, s: Settings, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    if not s.bootstrap and s.rate >= 1:
        return np.ones(draws.shape[1])
    drawn = _mixed(draws, s.seed * 1_000_003 + (0 if s.boosted and s.rate >= 1 else tree))
    if not s.bootstrap:
        return (drawn < s.rate).astype(float)
    # Poisson numbers by their cumulated probabilities.
    steps = [math.exp(-s.rate)]
    while steps[-1] > 1e-17 * s.rate or len(steps) < s.rate:
        steps.append(steps[-1] * s.rate / len(steps))
    return np.searchsorted(np.cumsum(steps), drawn, "right").astype(float)


def _drawn(y: np.ndarray, draws: np.ndarray, sums: np.ndarray, samples: list[tuple], s: Settings, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each row or cell is drawn for a tree, and the mean label of what is drawn."""
    own = _sample(s, tree)
    if own is None:
        return sums[0], y
    if len(sums) == 2:
        return _times(draws, s, tree), y
    at = 2 + 2 * samples.index(own)
    return sums[at], sums[at + 1]


# Growing


def _histograms(kind: str, key_type: pa.DataType, samples: list[tuple]):
    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def emitted(key) -> pa.RecordBatch:
            units = held.pop(key)
            rows = [(task, tree, blob, pickle.dumps((sums, n))) for (task, tree), (blob, sums, n) in units.items()]
            task, tree, blob, part = zip(*rows)
            cells = [pa.array([key] * len(rows), key_type), pa.array(task, pa.int32()), pa.array(tree, pa.int32()), pa.array(blob), pa.array(part)]
            return pa.RecordBatch.from_arrays(cells, names=["key", "task", "tree", "blob", "part"])

        for batch in batches:
            for i in range(batch.num_rows):
                key = batch["key"][i].as_py()
                if key not in held and len(held) == HELD:
                    yield emitted(next(iter(held)))
                own = held.setdefault(key, {})
                y, draws, counts = _block(batch, i)
                bins = pickle.loads(batch["bins"][i].as_py())
                preds = pickle.loads(batch["pred"][i].as_py()) if batch["pred"][i].is_valid else {}
                drawn: dict = {}
                for unit in batch["units"][i].as_py():
                    s, tree = pickle.loads(unit["blob"])
                    same = (s.folds, s.fold, s.fraction, s.train_split, s.rate, s.bootstrap, s.seed, unit["tree"])
                    if same not in drawn:
                        inside = _in_training(draws, s)
                        times, labels = _drawn(y, draws, counts, samples, s, unit["tree"])
                        times = np.where(inside, times, 0.0)
                        chosen = np.flatnonzero(times)
                        drawn[same] = (chosen, times[chosen], labels[chosen], int(counts[0, inside].sum()))
                    chosen, times, labels, n = drawn[same]
                    target = labels if unit["tree"] == 0 or not s.boosted else 2 * (labels - preds[unit["task"]][chosen])
                    sums = _sums(tree, bins[s.max_bins][:, chosen], times, target)
                    place = unit["task"], unit["tree"]
                    if place in own:
                        blob, before, rows = own[place]
                        own[place] = (blob, _padded(before, sums), rows + n)
                    else:
                        own[place] = (unit["blob"], sums, n)
        for key in list(held):
            yield emitted(key)

    return of_blocks


def _sums(tree: Tree, bins: np.ndarray, times: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Per feature, an array (open nodes, bins, 2) of weights and weighted targets."""
    at = tree.nodes(bins, tree.depth)
    place = np.full(len(tree.feature), -1)
    place[tree.open] = np.arange(len(tree.open))
    slot = place[at]
    live = slot >= 0
    slot, times, weighted = slot[live], times[live], (times * target)[live]
    out = []
    for own in bins[:, live]:
        width = int(own.max(initial=0)) + 1
        cell = slot * width + own
        size = len(tree.open) * width
        both = [np.bincount(cell, weights=w, minlength=size) for w in (times, weighted)]
        out.append(np.stack(both, -1).reshape(len(tree.open), width, 2))
    return out


def _padded(one: list[np.ndarray], other: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of two lists of arrays whose bins may end early."""
    out = []
    for a, b in zip(one, other):
        total = np.zeros((a.shape[0], max(a.shape[1], b.shape[1]), 2))
        total[:, : a.shape[1]] += a
        total[:, : b.shape[1]] += b
        out.append(total)
    return out


def _together(table: pa.Table) -> tuple[list[np.ndarray], int]:
    sums, n = None, 0
    for part in table["part"]:
        more, rows = pickle.loads(part.as_py())
        sums, n = (more if sums is None else _padded(sums, more)), n + rows
    return sums, n


def _merged(table: pa.Table) -> pa.Table:
    first = table.slice(0, 1)
    return first.drop_columns(["part", "slot"]).append_column("part", pa.array([pickle.dumps(_together(table))]))


def grown_level(s: Settings, tree: Tree, sums: list[np.ndarray], rows: int, number: int) -> Tree:
    """``tree`` with its open nodes split where that is worth it."""
    weight, target = sums[0][:, :, 0].sum(axis=1), sums[0][:, :, 1].sum(axis=1)
    tree = replace(tree, feature=tree.feature.copy(), cut=tree.cut.copy(), child=tree.child.copy(), value=tree.value.copy(), weight=tree.weight.copy())
    if tree.depth == 0:
        tree.rows = float(rows)
        tree.weight[0], tree.value[0] = weight[0], target[0] / weight[0] if weight[0] else 0.0
    least = max(s.min_weight * tree.rows, s.min_rows)
    n_features = len(sums)
    wanted = s.features_per_node(n_features)
    gains = np.full((n_features, len(tree.open)), -np.inf)
    cuts = np.zeros((n_features, len(tree.open)), np.int64)
    left = np.zeros((n_features, len(tree.open), 2))
    for f, own in enumerate(sums):
        if own.shape[1] < 2:
            continue
        below = np.cumsum(own, axis=1)[:, :-1]
        wl, sl = below[:, :, 0], below[:, :, 1]
        wr, sr = weight[:, None] - wl, target[:, None] - sl
        with np.errstate(all="ignore"):
            gain = (sl * sl / wl + sr * sr / wr - (target * target / weight)[:, None]) / weight[:, None]
            noise = 16 * EPS * np.maximum((sl / wl) ** 2, (sr / wr) ** 2)
        fits = (wl >= least) & (wr >= least) & (wl > 0) & (wr > 0) & (gain >= s.min_gain) & (gain > noise)
        gain = np.where(fits, gain, -np.inf)
        best = np.argmax(gain >= gain.max(axis=1, keepdims=True) * (1 - 1e-12), axis=1)
        at = np.arange(len(best))
        gains[f], cuts[f], left[f] = gain[at, best], best, below[at, best]
    if wanted < n_features:
        for k, node in enumerate(tree.open.tolist()):
            seen = np.random.default_rng([s.seed, number, node]).choice(n_features, wanted, replace=False)
            gains[np.setdiff1d(np.arange(n_features), seen), k] = -np.inf
    with np.errstate(invalid="ignore"):
        chosen = np.argmax(gains >= gains.max(axis=0) * (1 - 1e-12), axis=0)
    at = np.arange(len(tree.open))
    split = np.flatnonzero(np.isfinite(gains[chosen, at]))
    nodes, f = tree.open[split], chosen[split]
    first = len(tree.feature) + 2 * np.arange(len(split))
    tree.feature[nodes], tree.cut[nodes], tree.child[nodes] = f, cuts[f, split], first
    lower = left[f, split]
    upper = np.stack([weight[split], target[split]], -1) - lower
    pairs = np.stack([lower, upper], 1).reshape(-1, 2)
    more = len(pairs)
    return Tree(
        np.append(tree.feature, np.full(more, -1, np.int16)),
        np.append(tree.cut, np.zeros(more, np.int32)),
        np.append(tree.child, np.zeros(more, np.int32)),
        np.append(tree.value, pairs[:, 1] / pairs[:, 0]),
        np.append(tree.weight, pairs[:, 0]),
        tree.rows,
        tree.depth + 1,
        np.arange(len(tree.feature), len(tree.feature) + more) if tree.depth + 1 < s.max_depth else np.array([], np.int64),
    )


def _split(table: pa.Table) -> pa.Table:
    sums, n = _together(table)
    s, tree = pickle.loads(table["blob"][0].as_py())
    tree = grown_level(s, tree, sums, n, table["tree"][0].as_py())
    first = table.slice(0, 1).select(["key", "task", "tree"])
    return first.append_column("open", pa.array([len(tree.open) > 0])).append_column("blob", pa.array([pickle.dumps((s, tree))]))


def _grow(blocks: DataFrame, units: DataFrame, depth: int, salted: bool, samples: list[tuple]) -> DataFrame:
    """The trees of ``units (key, task, tree, open, blob)`` grown level by level."""
    kind, key_type = blocks.schema["key"].dataType.simpleString(), _arrow_type(blocks, "key")
    schema = f"key {kind}, task int, tree int, blob binary, part binary"
    for _ in range(depth):
        lists = units.where("open").groupBy("key").agg(F.collect_list(F.struct("task", "tree", "blob")).alias("units"))
        parts = blocks.select("key", "y", "draws", "sums", "bins", "pred").join(lists, "key").mapInArrow(_histograms(kind, key_type, samples), schema)
        if salted:
            slot = F.pmod(F.spark_partition_id(), F.lit(FAN_IN))
            parts = parts.withColumn("slot", slot).groupBy("key", "task", "tree", "slot").applyInArrow(_merged, schema)
        grown = parts.groupBy("key", "task", "tree").applyInArrow(_split, f"key {kind}, task int, tree int, open boolean, blob binary")
        units = written(grown.unionByName(units.where(~F.col("open"))))
    return units


def _alone(tasks: list[Settings], depths: dict[int, list[int]], stages: dict[int, list[int]], samples: list[tuple]):
    """All trees of a small key from all its blocks, with the errors asked for in the first row of each task."""

    def grown(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        parts = [(*_block(batch, i), pickle.loads(batch["bins"][i].as_py())) for i in range(batch.num_rows)]
        y, draws, counts = np.concatenate([p[0] for p in parts]), *(np.concatenate([p[k] for p in parts], axis=1) for k in (1, 2))
        bins = {b: np.concatenate([p[3][b] for p in parts], axis=1) for b in parts[0][3]}
        rows = []
        for task in batch["tasks"][0].as_py():
            s = tasks[task]
            own, inside = bins[s.max_bins], _in_training(draws, s)
            n_inside = int(counts[0, inside].sum())
            out = np.flatnonzero(_held_out(draws, s))
            trees, errors, pred = [], [], None
            for number in range(s.trees):
                times, labels = _drawn(y, draws, counts, samples, s, number)
                times = np.where(inside, times, 0.0)
                chosen = np.flatnonzero(times)
                target = labels if number == 0 or not s.boosted else 2 * (labels - pred)
                tree = Tree()
                for _ in range(s.max_depth):
                    if not len(tree.open):
                        break
                    tree = grown_level(s, tree, _sums(tree, own[:, chosen], times[chosen], target[chosen]), n_inside, number)
                trees.append(tree)
                if s.boosted:
                    added = tree.value[tree.nodes(own, s.max_depth)]
                    pred = added if number == 0 else pred + s.step * added
                    if number + 1 in stages[task] and tree.rows and len(out):
                        errors.append(_error(task, s.max_depth, number + 1, y[out], pred[out], counts[:, out]))
            if not s.boosted and len(out) and trees[0].rows:
                for depth in depths[task]:
                    p = sum(tree.value[tree.nodes(own[:, out], depth)] for tree in trees) / len(trees)
                    errors.append(_error(task, depth, s.trees, y[out], p, counts[:, out]))
            rows += [(task, number, pickle.dumps((s, tree)), errors if number == 0 else []) for number, tree in enumerate(trees)]
        n = len(rows)
        return pa.table({
            "key": pa.chunked_array([pa.concat_arrays([batch["key"].slice(0, 1)] * n)]),
            "task": pa.array([r[0] for r in rows], pa.int32()),
            "tree": pa.array([r[1] for r in rows], pa.int32()),
            "open": pa.array([False] * n),
            "blob": pa.array([r[2] for r in rows], pa.binary()),
            "errors": pa.array([r[3] for r in rows], pa.list_(ERRORS)),
        })

    return grown


# Scoring


def _error(task: int, depth: int, stage: int, y: np.ndarray, p: np.ndarray, sums: np.ndarray) -> dict:
    n, m2 = sums[:2]
    figures = {"n": int(n.sum()), "sse": float((m2 + n * (y - p) ** 2).sum()), "sy": float((n * y).sum()), "syy": float((m2 + n * y * y).sum())}
    return {"task": task, "depth": depth, "stage": stage, **figures}


def _forest_errors(batches: Iterator[pa.RecordBatch], depths: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            y, draws, counts = _block(batch, i)
            bins = pickle.loads(batch["bins"][i].as_py())
            tasks: dict[int, list] = {}
            for unit in batch["units"][i].as_py():
                tasks.setdefault(unit["task"], []).append(pickle.loads(unit["blob"]))
            errors = []
            for task, trees in tasks.items():
                s = trees[0][0]
                out = np.flatnonzero(_held_out(draws, s))
                if len(out) and trees[0][1].rows:
                    own = bins[s.max_bins][:, out]
                    for depth in depths[task]:
                        p = sum(tree.value[tree.nodes(own, depth)] for _, tree in trees) / len(trees)
                        errors.append(_error(task, depth, s.trees, y[out], p, counts[:, out]))
            yield pa.RecordBatch.from_arrays([batch["key"].slice(i, 1), pa.array([errors], pa.list_(ERRORS))], names=["key", "errors"])


def _advanced(batches: Iterator[pa.RecordBatch], stages: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
    """Blocks with the predictions after one more tree, and the errors of the stages asked for."""
    for batch in batches:
        for i in range(batch.num_rows):
            y, draws, counts = _block(batch, i)
            bins = pickle.loads(batch["bins"][i].as_py())
            preds = pickle.loads(batch["pred"][i].as_py()) if batch["pred"][i].is_valid else {}
            errors = batch["errors"][i].as_py()
            for unit in batch["units"][i].as_py():
                s, tree = pickle.loads(unit["blob"])
                added = tree.value[tree.nodes(bins[s.max_bins], s.max_depth)]
                task = unit["task"]
                preds[task] = added if unit["tree"] == 0 else preds[task] + s.step * added
                if unit["tree"] + 1 in stages[task] and tree.rows:
                    out = np.flatnonzero(_held_out(draws, s))
                    if len(out):
                        errors.append(_error(task, s.max_depth, unit["tree"] + 1, y[out], preds[task][out], counts[:, out]))
            row = [batch[c].slice(i, 1) for c in BLOCKS[:-2]]
            yield pa.RecordBatch.from_arrays([*row, pa.array([pickle.dumps(preds)]), pa.array([errors], pa.list_(ERRORS))], names=BLOCKS)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            s, tree = pickle.loads(batch["blob"][i].as_py())
            cuts, mean = pickle.loads(batch["cuts"][i].as_py())
            n, number = len(tree.feature), batch["tree"][i].as_py()
            own = cuts[s.max_bins]
            at = [own[f][c] if f >= 0 else None for f, c in zip(tree.feature.tolist(), tree.cut.tolist())]
            # The mean that labels were reduced by goes into the first boosted tree, or into every tree of a forest.
            value = tree.value + (mean if number == 0 or not s.boosted else 0.0)
            scale = (s.step if number else 1.0) if s.boosted else 1.0 / s.trees
            cells = [
                pa.concat_arrays([batch["key"].slice(i, 1)] * n),
                pa.array([batch["task"][i].as_py()] * n, pa.int32()),
                pa.array([number] * n, pa.int32()),
                pa.array(range(n), pa.int32()),
                pa.array(tree.levels(), pa.int32()),
                pa.array(tree.feature.astype(np.int32)),
                pa.array(at, pa.float64()),
                pa.array(tree.child.astype(np.int32)),
                pa.array(value),
                pa.array(tree.weight),
                pa.array([scale] * n, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cells, names=NODES)


NODES = ["key", "task", "tree", "node", "level", "feature", "threshold", "child", "value", "weight", "scale"]


@dataclass
class Grown:
    """``nodes``: a row per node (see ``NODES``). ``errors``: ``key, task, depth, stage, n, rmse, r2`` on held-out rows."""

    nodes: DataFrame
    errors: DataFrame


@dataclass
class Ready:
    """What trees are grown from: ``blocks`` (see ``binned``) and ``cuts`` of their keys, and the samples their sums are of."""

    blocks: DataFrame
    cuts: DataFrame
    samples: list[tuple]


def ready(
    df: DataFrame, key: str, features: list[str], label: str, row_id: str | list[str], tasks: list[Settings], keys: list | DataFrame | None = None, seed: int = 1
) -> Ready:
    """The rows of the wanted keys read, grouped and packed once for any number of calls of ``grow`` with some of ``tasks``."""
    packed = pack(df, key, features, label, row_id, keys, seed, tasks)
    cuts = bin_cuts(packed, len(features), sorted({s.max_bins for s in tasks}), tasks[0].train_split)
    return Ready(binned(packed, cuts, len(features)), cuts, list(samples_of(tasks)))


def grow(
    df: DataFrame,
    key: str,
    features: list[str],
    label: str,
    row_id: str | list[str],
    tasks: list[Settings],
    keys: list | DataFrame | None = None,
    seed: int = 1,
    depths: dict[int, list[int]] | None = None,
    stages: dict[int, list[int]] | None = None,
    which: DataFrame | None = None,
    known: Ready | None = None,
) -> Grown:
    """Grow all ``tasks`` for every key, or for each key those that ``which (key, task)`` names.

    ``known`` are their rows where they were made ready before. Other keys among them are left alone.
    Tasks are all forests or all boosted and share ``train_split``. Errors are those of whole ensembles, or per task of the ``depths``
    of a forest and of the ``stages`` (first so many trees) of boosting asked for.
    """
    boosted, train_split = {s.boosted for s in tasks}, {s.train_split for s in tasks}
    if len(boosted) != 1 or len(train_split) != 1:
        raise ValueError("tasks grown together are of one kind and one train_split")
    known = known or ready(df, key, features, label, row_id, tasks, keys, seed)
    blocks, cuts, samples = known.blocks, known.cuts, known.samples
    if which is not None:
        which = written(which.select(quoted(key).alias("key"), "task"))
        blocks = blocks.join(which.select("key").distinct(), "key", "left_semi")
    salted = blocks.rdd.getNumPartitions() > FAN_IN
    depth = max(s.max_depth for s in tasks)
    depths = {k: [s.max_depth] for k, s in enumerate(tasks)} | (depths or {})
    stages = {k: [s.trees] for k, s in enumerate(tasks)} | (stages or {})
    blobs = [pickle.dumps((s, Tree())) for s in tasks]

    listed = cuts.select("key", F.explode(F.sequence(F.lit(0), F.lit(len(tasks) - 1))).alias("task"))
    if which is not None:
        listed = listed.join(which, ["key", "task"], "left_semi")
    kind = blocks.schema["key"].dataType.simpleString()
    sizes = written(blocks.groupBy("key").agg(F.sum("n").alias("rows")))
    small = F.col("rows") * len(features) <= ALONE_VALUES
    n_small, n_keys = sizes.where(small).count(), sizes.count()
    found: list[DataFrame] = []
    errors: list[DataFrame] = []
    if n_small or not n_keys:
        slots = max(1, min(len(tasks), SPREAD // max(n_small, 1)))
        spread = listed.join(sizes.where(small).select("key"), "key", "left_semi")
        spread = spread.groupBy("key", (F.col("task") % slots).alias("slot")).agg(F.sort_array(F.collect_list("task")).alias("tasks"))
        meeting = blocks.select("key", "y", "draws", "sums", "bins").join(spread, "key")
        schema = f"key {kind}, task int, tree int, open boolean, blob binary, errors {ERRORS_SQL}"
        alone = written(meeting.groupBy("key", "slot").applyInArrow(_alone(tasks, depths, stages, samples), schema))
        found.append(alone.drop("errors"))
        errors.append(alone.select("key", F.inline("errors")))
    large = sizes.where(~small).select("key")
    blocks = blocks.join(large, "key", "left_semi")

    def units_of(numbers: list[tuple[int, int]]) -> DataFrame:
        """Fresh trees ``(task, tree)`` of every large key."""
        fresh = df.sparkSession.createDataFrame([(task, [(tree, bytearray(blobs[task])) for t, tree in numbers if t == task]) for task in range(len(tasks))], "task int, trees array<struct<tree:int,blob:binary>>")
        own = listed.join(large, "key", "left_semi").join(F.broadcast(fresh), "task")
        return written(own.select("key", "task", F.inline("trees")).withColumn("open", F.lit(True)))

    if n_small == n_keys:
        pass
    elif boosted.pop():
        fresh = units_of([(k, tree) for k, s in enumerate(tasks) for tree in range(s.trees)])
        for tree in range(max(s.trees for s in tasks)):
            units = _grow(blocks, fresh.where(F.col("tree") == tree), depth, salted, samples)
            found.append(units)
            lists = units.groupBy("key").agg(F.collect_list(F.struct("task", "tree", "blob")).alias("units"))
            # A key without unfinished tasks keeps its blocks.
            blocks = written(blocks.join(lists, "key", "left").withColumn("units", F.coalesce("units", F.array())).mapInArrow(lambda b: _advanced(b, stages), blocks.schema))
        errors.append(blocks.select("key", F.inline("errors")))
    else:
        units = _grow(blocks, units_of([(k, tree) for k, s in enumerate(tasks) for tree in range(s.trees)]), depth, salted, samples)
        found.append(units)
        lists = units.groupBy("key").agg(F.collect_list(F.struct("task", "tree", "blob")).alias("units"))
        scored = blocks.select("key", "y", "draws", "sums", "bins").join(lists, "key").mapInArrow(lambda b: _forest_errors(b, depths), f"key {kind}, errors {ERRORS_SQL}")
        errors.append(written(scored).select("key", F.inline("errors")))
    units, all_errors = reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, errors)
    schema = f"key {kind}, task int, tree int, node int, level int, feature int, threshold double, child int, value double, weight double, scale double"
    nodes = written(units.join(cuts, "key").mapInArrow(_nodes, schema))
    spread = F.sum("syy") - F.sum("sy") * F.sum("sy") / F.sum("n")
    measured = all_errors.groupBy("key", "task", "depth", "stage").agg(
        F.sum("n").alias("n"),
        F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"),
        F.when(spread > 0, 1 - F.sum("sse") / spread).alias("r2"),
    )
    return Grown(nodes.withColumnRenamed("key", key), written(measured).withColumnRenamed("key", key))


def predicted(df: DataFrame, nodes: DataFrame, key: str, features: list[str], output: str = "prediction") -> DataFrame:
    """``df`` with the prediction of its key's trees (null where a key has none, or a feature is missing), in one plan.

    Every key's nodes become one row of arrays; a row walks from each root down, as many steps as its key's trees have levels.
    """
    each = F.struct("tree", "node", "feature", "threshold", "child", "value", "scale")
    trees = nodes.groupBy(quoted(key).alias("_key")).agg(F.sort_array(F.collect_list(each)).alias("_nodes"), F.max("level").alias("_levels"))
    places = F.sequence(F.lit(0), F.size("_nodes") - 1)
    trees = trees.withColumn("_roots", F.filter(places, lambda i: F.col("_nodes")[i]["node"] == 0))
    x = F.array(*[quoted(c).cast("double") for c in features])

    def walk(root: Column) -> Column:
        def step(at: Column, _) -> Column:
            node = F.col("_nodes")[at]
            right = F.when(x[node["feature"]] <= node["threshold"], 0).otherwise(1)
            return F.when(node["feature"] < 0, at).otherwise(root + node["child"] + right)

        return F.aggregate(F.array_repeat(F.lit(0), F.col("_levels")), root, step)

    leaves = F.transform("_roots", lambda root: F.col("_nodes")[walk(root)])
    total = F.aggregate(leaves, F.lit(0.0), lambda before, leaf: before + leaf["value"] * leaf["scale"])
    complete = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    joined = df.join(trees, quoted(key) == F.col("_key"), "left")
    return joined.withColumn(output, F.when(complete & F.col("_key").isNotNull(), total)).drop("_key", "_nodes", "_levels", "_roots")
