"""N-gram Jaccard join with set relations (operator 1).

Two documents link when their sets of word shingles have a Jaccard similarity of 75 % or more; the answer is each
document's connected component. The join is exact, up to collisions of 64-bit hashes within a pair of sets.

1. *Sets with company.* Every shingle goes, as 32 bits in a bucket of shingles, to where its copies go; a document of
   which less than 75 % of the shingles occur elsewhere links with nothing. Shingles that occur twice in a task's own
   documents are known to be shared and sent once, so a line that a third of all documents have costs one entry per
   task.
2. *Classes.* Equal sets become one, with a number in the order of their smallest ids; an id that stands in several rows
   can be the smallest of several classes.
3. *Index.* Shingles are ordered by frequency; a set is listed under its rarest ones, as many as any partner must hit.
   Lists are cut into blocks of one size class and one range of positions. A block that can't hold enough shingles
   behind its positions is skipped whole.
4. *Leaders.* In each list the smallest id leads. A set is compared with the leader that most of its lists name; sets
   that link with it take over its component.
5. *Derived answers.* What a set shares with its leader bounds what two sets of one leader share with each other:
   pairs beyond the bounds are answered without looking at the sets. Pairs within one component are not asked again.
   Only what is left is compared, and the components that link are united.

Defined cases: null and empty texts have an empty set and link with nothing; a text of fewer than five words is one
shingle. Rows repeating an id are rows of their own in the result. A row without id has its set's size and no
component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from keyspan.llm.bitmaps import marked
from keyspan.llm.components import connected
from keyspan.llm.shingles import WORDS, digest, mixed, shingle_sets
from keyspan.llm.staging import staged
from keyspan.operators.frames import quoted

# Similarity in hundredths.
LEAST = 75
# Shingles of one bucket, about; of one round of a task; documents of one group; postings of one block.
BUCKET_SHINGLES = 1_000_000
CHUNK_SHINGLES = 1_000_000
GROUP_DOCS = 20_000
BLOCK = 512
# Ratio of the sizes in one class: linked sets differ by one class at most.
SIZE_STEP = 100 / LEAST
# Width of a range of positions in a block.
POSITIONS = 16
# Stand for the documents of a task that share a shingle, and for a document without id.
_SEVERAL = np.iinfo(np.int64).min
_NO_ID = _SEVERAL + 1


def _needed(n: Column) -> Column:
    """The least number of shingles that a set of ``n`` shares with any partner."""
    return F.ceil(n * LEAST / 100)


def _needed_with(n: Column, m: Column) -> Column:
    """The least number of shingles that two linked sets of ``n`` and ``m`` share."""
    return F.ceil((n + m) * LEAST / (100 + LEAST))


def _parts(ids: np.ndarray, sets: list[np.ndarray], buckets: int) -> tuple[np.ndarray, list[tuple[int, bytes, bytes, bytes]]]:
    """Per set how many shingles other sets here have too; the entries for the buckets: hashes, ids and how many hashes each id has."""
    sizes = np.array([len(s) for s in sets], np.int64)
    shingles = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    if not len(shingles):
        return np.zeros(len(sets), np.int64), []
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(shingles)
    ranked = shingles[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    single = first & np.concatenate((first[1:], [True]))
    local = np.bincount(owner[order[~single]], minlength=len(sets))
    # Single shingles in the order of their sets, then one entry for each that several sets have.
    singles = np.sort(order[single])
    several = ranked[first & ~single]
    entries = np.concatenate((shingles[singles], several))
    whose = np.concatenate((ids[owner[singles]], np.full(len(several), _SEVERAL)))
    bucket = ((entries >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    by_bucket = np.argsort(bucket, kind="stable")
    entries, whose, bucket = entries[by_bucket].astype(np.uint32), whose[by_bucket], bucket[by_bucket].astype(np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        begins = np.flatnonzero(np.concatenate(([True], whose[a + 1 : b] != whose[a : b - 1])))
        counts = np.diff(np.concatenate((begins, [b - a]))).astype(np.uint32)
        out.append((int(bucket[a]), entries[a:b].tobytes(), whose[a:b][begins].tobytes(), counts.tobytes()))
    return local, out


_PART_SCHEMA = "bucket int, hashes binary, ids binary, counts binary, n binary, first binary, second binary"
_PART_NAMES = [x.split()[0] for x in _PART_SCHEMA.split(", ")]
_COUNT_SCHEMA = "owner int, ids binary, shared binary, n binary, first binary, second binary"
_COUNT_NAMES = [x.split()[0] for x in _COUNT_SCHEMA.split(", ")]
_DOC_SCHEMA = "doc_id long, n long, first long, second long, company boolean"


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=_PART_NAMES)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that texts are Python objects only briefly."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def _dealt_out(ids: np.ndarray, groups: int, columns: list[np.ndarray]) -> pa.Table:
    """The columns cut by the group of the document, one row per group."""
    with np.errstate(over="ignore"):
        owner = (mixed(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int32)
    nameless = ids == _NO_ID
    owner[nameless] = np.arange(int(nameless.sum())) % groups
    order = np.argsort(owner, kind="stable")
    owner, columns = owner[order], [c[order] for c in (ids, *columns)]
    cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(owner) else np.zeros(1, np.int64)
    parts = [[c[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for c in columns]
    parts += [[b""] * (len(cuts) - 1)] * (len(_COUNT_NAMES) - 1 - len(parts))
    return pa.table([pa.array(owner[cuts[:-1]], pa.int32()), *(pa.array(p, pa.binary()) for p in parts)], names=_COUNT_NAMES)


def _documents(rows: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, first, second, company`` per row: the size of its set, 128 bits of it, and whether enough of it occurs elsewhere to link."""
    size = rows.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("docs")).first()
    buckets = max(1, -(-(size["chars"] or 0) // (7 * BUCKET_SHINGLES)))
    groups = max(1, -(-size["docs"] // GROUP_DOCS))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, digests, held, sent = [], [], [], 0, 0

        def flushed() -> pa.RecordBatch:
            local, entries = _parts(np.array(ids, np.int64), sets, buckets)
            marks = np.array(digests, np.int64).reshape(len(ids), 2)
            # The documents themselves, dealt out evenly: a negative bucket.
            sizes = np.array([len(s) for s in sets], np.int64)
            columns = (local.astype(np.int64), np.array(ids, np.int64), np.zeros(0), sizes, marks[:, 0], marks[:, 1])
            own = (-1 - (ids[0] + sent) % buckets, *(c.tobytes() for c in columns))
            return _part_batch([own, *((*e, b"", b"", b"") for e in entries)])

        for part in _slices(batches):
            for doc, shingles in zip(part["doc_id"].to_pylist(), shingle_sets(part["text"].to_pylist(), words), strict=True):
                ids.append(_NO_ID if doc is None else doc)
                sets.append(shingles)
                digests.append(digest(shingles))
                held += len(shingles) + 1
                if held >= CHUNK_SHINGLES:
                    yield flushed()
                    ids, sets, digests, held, sent = [], [], [], 0, sent + 1
        if ids:
            yield flushed()

    def counted(table: pa.Table) -> pa.Table:
        ids = _joined(table, "ids", np.int64)
        if table["bucket"][0].as_py() < 0:
            return _dealt_out(ids, groups, [_joined(table, x, np.int64) for x in ("hashes", "n", "first", "second")])
        hashes, whose = _joined(table, "hashes", np.uint32), np.repeat(ids, _joined(table, "counts", np.uint32))
        order = np.argsort(hashes)
        ranked = hashes[order]
        same = ranked[1:] == ranked[:-1]
        shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        docs, counts = np.unique(whose[order[shared]], return_counts=True)
        known = docs > _NO_ID
        return _dealt_out(docs[known], groups, [counts[known].astype(np.int64)])

    def judged(table: pa.Table) -> pa.Table:
        ids, shared = _joined(table, "ids", np.int64), _joined(table, "shared", np.int64)
        names, place = np.unique(ids, return_inverse=True)
        total = np.bincount(place, shared, len(names))
        own = table.filter(pa.compute.not_equal(pa.compute.binary_length(table["n"]), 0))
        ids, n, first, second = (_joined(own, x, np.int64) for x in ("ids", "n", "first", "second"))
        company = (n > 0) & (ids != _NO_ID) & (100 * total[np.searchsorted(names, ids)] >= LEAST * n)
        return pa.table([pa.array(ids, mask=ids == _NO_ID), n, first, second, company], names=["doc_id", "n", "first", "second", "company"])

    entries = rows.mapInArrow(dealt, _PART_SCHEMA).groupBy("bucket").applyInArrow(counted, _COUNT_SCHEMA)
    return entries.groupBy("owner").applyInArrow(judged, _DOC_SCHEMA)


def _class_sets(rows: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """``rep, n, shingles`` per class (``rep, class_id, first, second``), from the text of its smallest id."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            found = list(shingle_sets(part["text"].to_pylist(), words))
            marks = [digest(s) for s in found]
            # An id can stand in several rows: only the text of the class counts.
            right = [m == w for m, w in zip(marks, zip(part["first"].to_pylist(), part["second"].to_pylist(), strict=True), strict=True)]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in found])))
            values = pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            whole = pa.RecordBatch.from_arrays([part["rep"], pa.array([len(s) for s in found], pa.int32()), lists], names=["rep", "n", "shingles"])
            yield whole.filter(pa.array(right, pa.bool_()))

    wanted = classes.select("rep", F.col("class_id").alias("doc_id"), "first", "second")
    # A filter drops nearly all other texts before the shuffle; what it lets pass the join sorts out.
    likely = marked(rows, "doc_id", wanted.select("doc_id"), "likely").where("likely")
    joined = likely.join(wanted, "doc_id").select("rep", "text", "first", "second")
    return joined.mapInArrow(sets, "rep long, n int, shingles array<long>").dropDuplicates(["rep"])


def _indexed(sets: DataFrame) -> DataFrame:
    """``rep, n, shared, prefix``: the shingles that other sets have, sorted, and those to list the set under, with positions.

    Positions count the shingles of the whole set from the rarest; those that no other set has come first and are not listed.
    """
    each = sets.select("rep", "n", F.explode("shingles").alias("shingle"))
    frequent = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(frequent, "shingle").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("ranked"))
    spare = F.size("ranked") - _needed(F.col("n"))
    position = F.col("n") - F.size("ranked") + 1
    listed = F.transform(
        F.slice("ranked", 1, spare + 1), lambda x, i: F.struct(x["shingle"].alias("shingle"), (position + i).alias("pos"))
    )
    shared = F.sort_array(F.transform("ranked", lambda x: x["shingle"]))
    return ranked.where(spare >= 0).select("rep", "n", shared.alias("shared"), listed.alias("prefix"))


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (``a, b``) with ``n_a, n_b, common``: how many shingles the two sets share."""
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("set_b"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                at = np.searchsorted(y, x)
                common.append(int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(x) and len(y) else 0)
            kept = ["a", "b", "n_a", "n_b"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(common, pa.int64())], names=[*kept, "common"])

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "set_a", "set_b")
    return both.mapInArrow(counted, "a long, b long, n_a int, n_b int, common long")


def _links(common: DataFrame) -> DataFrame:
    return common.where((100 + LEAST) * F.col("common") >= LEAST * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _led(postings: DataFrame) -> DataFrame:
    """``a, b``: each set with the leader that most of its lists name."""
    leaders = postings.groupBy("shingle").agg(F.min("rep").alias("leader"), F.count("*").alias("many")).where("many > 1")
    named = postings.join(leaders, "shingle").where("rep != leader").groupBy("rep", "leader").count()
    best = named.groupBy("rep").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader"))
    return best.select(F.col("rep").alias("a"), F.col("leader").alias("b"))


def _open_pairs(postings: DataFrame, known: DataFrame) -> DataFrame:
    """``a, b, sure`` for the pairs of different components that can link; ``sure`` where their leader's answers say so.

    ``known`` has ``rep, comp, leader, leader_n, with_leader``.
    """
    listed = postings.join(known, "rep")
    groups = listed.groupBy("shingle", "comp").agg(F.count("*").alias("many"))
    major = F.max_by("comp", F.struct("many", "comp")).alias("major")
    lists = groups.groupBy("shingle").agg(major, F.sum("many").alias("length"), F.count("*").alias("comps"))
    lists = lists.where("comps > 1").drop("comps")
    mixed_lists = staged(listed.join(lists, "shingle"))
    klass = F.floor(F.log(F.col("n").cast("double")) / float(np.log(SIZE_STEP)) + 1e-9).cast("int")
    blocks = (
        mixed_lists.withColumn("klass", klass)
        .withColumn("range", F.floor(F.col("pos") / POSITIONS))
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("length") / BLOCK)))
        .groupBy("shingle", "klass", "range", "part")
        .agg(
            F.max(F.col("n") - F.col("pos")).alias("behind"),
            F.min("n").alias("least_n"),
            F.collect_list(F.struct("rep", "n", "pos", "comp", "major", "leader", "leader_n", "with_leader")).alias("members"),
        )
    )
    # Every pair of different components has a side outside the list's largest one: that side asks.
    asking = mixed_lists.where("comp != major").withColumn("klass", F.explode(F.array(klass - 1, klass, klass + 1)))
    asking = asking.select("shingle", "klass", *(F.col(c).alias(f"a_{c}") for c in ("rep", "n", "pos", "comp", "leader", "leader_n", "with_leader")))
    n, m = F.col("a_n"), F.col("m.n")
    # The smallest partner in a block, and the most that any of it can share from here on: else the block is skipped.
    smallest = F.greatest("least_n", F.ceil(n * LEAST / 100))
    most = F.least(n - F.col("a_pos"), F.col("behind")) + 1
    met = asking.join(blocks, ["shingle", "klass"]).where(most >= _needed_with(n, smallest))
    pairs = met.withColumn("m", F.explode("members")).where(
        (F.col("m.comp") != F.col("a_comp"))
        & ((F.col("m.comp") == F.col("m.major")) | (F.col("m.rep") < F.col("a_rep")))
        & (100 * F.least(n, m) >= LEAST * F.greatest(n, m))
        & (F.least(n - F.col("a_pos"), m - F.col("m.pos")) + 1 >= _needed_with(n, m))
    )
    # x and y are what the two share with one leader of size z: x + y - z at least, and no more than the smaller of both beside the rest.
    x, y, z = F.col("a_with_leader"), F.col("m.with_leader"), F.col("a_leader_n")
    led = F.col("a_leader") == F.col("m.leader")
    at_least, at_most = x + y - z, F.least(x, y) + F.least(n - x, m - y)
    pairs = pairs.where(~led | (at_most >= _needed_with(n, m)))
    sure = led & (at_least >= _needed_with(n, m))
    ordered = pairs.select(F.greatest("a_rep", "m.rep").alias("a"), F.least("a_rep", "m.rep").alias("b"), sure.alias("sure"))
    return ordered.groupBy("a", "b").agg(F.max("sure").alias("sure"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, digests: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` per row of ``docs``: the size of its set, the smallest id that it reaches by links, the smallest id with an equal set. ``digests`` adds ``first, second``, 128 bits of the set."""
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    own = staged(_documents(rows, words))
    named = own.where("company").groupBy("first", "second").agg(F.min("doc_id").alias("class_id"))
    # Numbers follow the ids; written once, they stay.
    classes = staged(named.orderBy("class_id", "first", "second").withColumn("rep", F.monotonically_increasing_id()))
    sets = staged(_class_sets(rows, classes, words))
    indexed = staged(_indexed(sets))
    postings = indexed.select("rep", "n", F.inline("prefix"))
    led = staged(_common(_led(postings), indexed))
    first_links = staged(_links(led))
    first = staged(connected(first_links))
    known = (
        indexed.select("rep", "n")
        .join(first.withColumnRenamed("node", "rep"), "rep", "left")
        .join(led.drop("n_a").toDF("rep", "leader", "leader_n", "with_leader"), "rep", "left")
        .select(
            "rep",
            F.coalesce("component", "rep").alias("comp"),
            F.coalesce("leader", "rep").alias("leader"),
            F.coalesce("leader_n", "n").alias("leader_n"),
            F.coalesce("with_leader", F.col("n").cast("long")).alias("with_leader"),
        )
    )
    known = staged(known)
    pairs = staged(_open_pairs(postings, known))
    late = _links(_common(pairs.where("not sure").select("a", "b"), indexed)).union(pairs.where("sure").select("a", "b"))
    comp = known.select("rep", "comp")
    united = (
        late.join(comp.select(F.col("rep").alias("a"), F.col("comp").alias("x")), "a")
        .join(comp.select(F.col("rep").alias("b"), F.col("comp").alias("y")), "b")
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
        .distinct()
    )
    second = connected(united).select(F.col("node").alias("comp"), F.col("component").alias("united"))
    reached = comp.join(second, "comp", "left").select("rep", F.coalesce("united", "comp").alias("component"))
    reached = staged(classes.join(reached, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    least = reached.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = reached.join(least, "component").select("first", "second", "class_id", "component_id")
    linked = own.join(named, ["first", "second"], "left")
    return linked.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        *(["first", "second"] if digests else []),
    )


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` without the rows that reach a smaller id by links. Rows that repeat an id are told apart by their sets."""
    found = jaccard_components(docs, doc_id, text, words, digests=True).where("doc_id != component_id")
    gone = staged(found.select(F.col("doc_id").alias("_nc_id"), F.col("first").alias("_nc_first"), F.col("second").alias("_nc_second")).distinct())
    rows = docs.withColumn("_nc_doc", quoted(doc_id).cast("long")).withColumn("_nc_text", quoted(text))
    likely = marked(rows, "_nc_doc", gone.select("_nc_id"), "_nc_likely")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            marks = np.array([digest(s) for s in shingle_sets(part["_nc_text"].to_pylist(), words)], np.int64).reshape(part.num_rows, 2)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(marks[:, 0]), pa.array(marks[:, 1])], names=[*part.schema.names, "_nc_one", "_nc_two"])

    # The columns travel as one, under names that any schema can have.
    row = F.struct(*(quoted(c).alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("_nc_row")
    asked = likely.where("_nc_likely").select(row, "_nc_doc", "_nc_text")
    asked = asked.mapInArrow(digested, StructType([*asked.schema.fields, StructField("_nc_one", LongType()), StructField("_nc_two", LongType())]))
    same = (F.col("_nc_doc") == F.col("_nc_id")) & (F.col("_nc_one") == F.col("_nc_first")) & (F.col("_nc_two") == F.col("_nc_second"))
    others = asked.join(gone, same, "left_anti").select(*(F.col(f"_nc_row.c{k}").alias(c) for k, c in enumerate(docs.columns)))
    return likely.where("not _nc_likely").select(*map(quoted, docs.columns)).union(others)
