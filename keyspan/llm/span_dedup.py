"""Substring deduplication by sliding sentence spans (operator 9).

A text is cut into sentences; every run of ``SPAN`` consecutive ones is hashed, and all runs of all documents meet by
hash. A run that occurs more than once stays where it comes first, by id and place; sentences that any other
occurrence covers are removed.

Texts are cut once and written with the hashes of their runs as arrays. Half of each hash is counted first, combined before its
shuffle; a Bloom filter of those that repeat lets through the runs that may have a copy, and only these are written as rows and
shuffled with their places. Fewer than ``HOT`` runs can each hold more than one in ``HOT`` of these rows: their first places are
broadcast, so that a passage which every document has meets its copies where they are. Texts that lose nothing aren't shuffled.

Words between two cuts are a sentence. A cut may stand between any two words; its rank is that of the two words alone:
behind a full stop, question or exclamation mark before all others, and then by their hash. Cuts are taken by rank, each
unless one within ``LEAST_WORDS`` words is taken already. So sentences have 5 to 9 words, whatever marks or line ends
stand in between, a run has 15 to 27, and what a cut depends on ends a few words away: a passage is cut alike wherever
it stands, but for some words at either side. No rule of disjoint sentences can promise a run to every passage of over
50 words. This one gave one to each of 16,045 passages of 51 words from anywhere in the sf0.1 texts, put into two other
texts, to each of 16,045 without punctuation and of 16,045 that repeat up to 29 words, and to all but 2 of 16,045 made
of three words at random; to all of each kind at 60 words.

Defined cases: null and empty texts stay as they are. Texts of fewer than 10 words are one sentence, those of fewer
than three sentences (18 words at most) have no runs. A null id comes before all others. Rows repeating an id and text
(128 bits of them) count as one document. Cuts and runs do not regard the case of A-Z or white space; runs are compared by 128-bit hashes.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.bitmaps import marked
from keyspan.llm.staging import staged
from keyspan.operators.frames import quoted

SPAN = 3
LEAST_WORDS = 5
# Runs with more than one in so many of the rows that meet by hash are looked up in a broadcast table, of fewer rows than this.
HOT = 1000
# Slots of the filter of repeated hashes for each of them: one in eight unique runs gets through.
SLOTS = 8
# What tells rows apart.
_MARKS = ["mark", "mark2"]
_WORD = re.compile(r"\S+")
_END = tuple(".!?。！？…")
_QUOTES = "\"')]}»”’"


def _lowered(words: list[str]) -> list[bytes]:
    return " ".join(words).encode("utf-8", "surrogatepass").lower().split(b" ")


def _ends(word: str) -> bool:
    return word[-1] in _END or word[-1] in _QUOTES and word.rstrip(_QUOTES).endswith(_END)


def _bounds(words: list[str], forms: list[bytes]) -> list[int]:
    """The number of words before each sentence, and that of all words."""
    n, least = len(words), LEAST_WORDS
    if n < 2 * least:
        return [0, n] if n else []
    marks = np.fromiter(map(crc32, forms), np.uint64, n)
    ranks = (marks[:-1] * _MIX[0] ^ marks[1:] * _MIX[1]) * _MIX[2] >> _ONE
    ranks[~np.fromiter(map(_ends, words[:-1]), bool, n - 1)] |= _HIGHEST
    near, taken, bounds = bytearray(n + least), b"\1" * (2 * least - 1), [0, n]
    # Between equal ranks the first goes first: repeated words are cut at even distances.
    for cut in (np.argsort(ranks[least - 1 : n - least], kind="stable") + least).tolist():
        if not near[cut]:
            near[cut - least + 1 : cut + least] = taken
            bounds.append(cut)
    return sorted(bounds)


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
_ONE, _HIGHEST = np.uint64(1), np.uint64(1 << 63)


def sentences(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, normal form)`` of the sentences; together they cover the text but for white space before and after."""
    places = [found.span() for found in _WORD.finditer(text or "")]
    words = [text[start:end] for start, end in places]
    forms = _lowered(words)
    bounds = _bounds(words, forms)
    pairs = zip(bounds, bounds[1:], strict=False)
    return [(places[a][0], places[b - 1][1], b" ".join(forms[a:b]).decode("utf-8", "surrogatepass")) for a, b in pairs]


def without_sentences(text: str, removed: set[int]) -> str:
    """``text`` without these sentences, and without the white space behind each."""
    cut = sentences(text)
    kept, at = [], 0
    for k, (start, _, _) in enumerate(cut):
        if k in removed:
            kept.append(text[at:start])
            at = cut[k + 1][0] if k + 1 < len(cut) else len(text)
    return "".join([*kept, text[at:]]).rstrip() if removed else text


def _cut(text: str | None, span: int) -> tuple[int, list[tuple[int, int]]]:
    """The number of sentences, and the hashes of the runs in order."""
    words = (text or "").split()
    forms = _lowered(words)
    bounds = _bounds(words, forms)
    runs = zip(bounds, bounds[span:], strict=False)
    return max(0, len(bounds) - 1), [divmod(xxhash.xxh3_128_intdigest(b" ".join(forms[a:b])), 1 << 64) for a, b in runs]


def _with_runs(rows: DataFrame, span: int) -> DataFrame:
    """``rows`` with ``n_sentences`` and two arrays of the halves of its runs' hashes, ``high`` and ``low``."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                n, ends, hashes = [], [0], []
                for one in part["text"]:
                    n_sentences, runs = _cut(one.as_py(), span)
                    n.append(n_sentences)
                    hashes += runs
                    ends.append(len(hashes))
                halves = np.array(hashes, np.uint64).reshape(len(hashes), 2).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(halves[:, k])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64()), *lists], names=[*part.schema.names, "n_sentences", "high", "low"])

    types = f"doc_id {id_type}, text string, mark long, mark2 long, n_sentences long, high array<long>, low array<long>"
    return rows.select("doc_id", "text", *_MARKS).mapInArrow(hashed, types)


def _repeats(cut: DataFrame) -> DataFrame:
    """``mark, mark2, place`` of the runs that occurred before."""
    again = staged(cut.select(F.explode("low").alias("low")).groupBy("low").count().where("count > 1").select("low"))
    places = cut.select("doc_id", *_MARKS, F.posexplode(F.arrays_zip("high", "low")).alias("place", "run")).select("doc_id", *_MARKS, "place", "run.*")
    likely = staged(marked(places, "low", again, "likely", SLOTS).where("likely").drop("likely"))
    own = F.struct("doc_id", "place", *_MARKS)
    firsts = staged(likely.groupBy("high", "low").agg(F.min(own).alias("first"), F.count("*").alias("times")).where("times > 1"))
    is_hot = F.col("times") * HOT > likely.count()
    hot = F.broadcast(firsts.where(is_hot).drop("times"))
    met = likely.join(hot, ["high", "low"])
    others = likely.join(hot, ["high", "low"], "left_anti").join(firsts.where(~is_hot).drop("times"), ["high", "low"])
    return met.unionByName(others).where(~own.eqNullSafe(F.col("first"))).select(*_MARKS, "place")


def remove_repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """``doc_id, n_sentences, n_removed, text`` per row of ``docs``."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64(F.isnull("doc_id"), "doc_id", "text")).withColumn("mark2", F.xxhash64("text", "doc_id"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, texts = [], []
            for one, starts in zip(batch["text"].to_pylist(), batch["starts"].to_pylist(), strict=True):
                covered = {k + i for k in starts or () for i in range(span)}
                gone.append(len(covered))
                texts.append(without_sentences(one, covered) if covered else one)
            columns = [batch["doc_id"], batch["n_sentences"], pa.array(gone, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_sentences", "n_removed", "text"])

    cut = staged(_with_runs(rows, span))
    starts = staged(_repeats(cut).groupBy(*_MARKS).agg(F.collect_set("place").alias("starts")))
    texts = marked(cut.drop("high", "low"), "mark", starts.select("mark"), "likely")
    whole = texts.where("not likely").select("doc_id", "n_sentences", F.lit(0).cast("long").alias("n_removed"), "text")
    found = texts.where("likely").join(starts, _MARKS, "left").select("doc_id", "n_sentences", "text", "starts")
    return whole.union(found.mapInArrow(cleaned, f"doc_id {id_type}, n_sentences long, n_removed long, text string"))
