"""Benchmark decontamination with a generalised suffix automaton (operator 5).

The automaton of all test items accepts every run of words that occurs in an item. The words of a document stream
through it; at each word it holds the longest run ending there that an item contains. Runs of ``window`` words or more
are matches, and so is a whole item of fewer words. The words of all matches are the document's spans.

Items are broadcast in blocks of about ``BLOCK_WORDS`` words, read in one pass that holds a block at a time. Documents pass
``BLOCKS_AT_ONCE`` blocks in a stage; then they are written, those blocks go, and the next follow. So a larger benchmark adds
stages without a shuffle, and neither the driver, the broadcasts nor the workers hold more than those blocks. Each Python worker
builds a block's automaton once.

Defined cases: null and empty texts have no words, no spans and are clean. Items without words or id are left out;
rows repeating an item's id count as one item. Repeated documents are judged one by one. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.staging import staged
from keyspan.operators.frames import quoted

WINDOW = 13
# A document is contaminated from one hit word in so many.
SHARE = 20
# Words of one automaton: about 150 MB in a Python worker.
BLOCK_WORDS = 200_000
# Automata that documents pass in one stage, each in a Python worker of its own.
BLOCKS_AT_ONCE = 3
# Bytes that are no part of a word, in lower-cased text; all bytes of characters outside ASCII are.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MATCHES = "spans array<struct<start: int, end: int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """Of several word sequences; state 0 is the empty run."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.nexts: list[dict[bytes, int]] = [{}]
        self.links, self.lengths = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extended(last, word)
        # Per state the runs that count as matches: words and item.
        self.ends: dict[int, dict[int, set[str]]] = {}
        for item, words in items:
            self._mark(item, words, min(window, len(words)))
        self.least = min((n for ends in self.ends.values() for n in ends), default=0)
        # The nearest state on the way to the root, itself included, that ends a match.
        self.nearest = [0] * len(self.links)
        for state in sorted(range(1, len(self.links)), key=self.lengths.__getitem__):
            self.nearest[state] = state if state in self.ends else self.nearest[self.links[state]]

    def _new(self, length: int, nexts: dict[bytes, int], link: int) -> int:
        self.lengths.append(length)
        self.nexts.append(nexts)
        self.links.append(link)
        return len(self.links) - 1

    def _split(self, state: int, word: bytes) -> int:
        """The state for ``state`` and ``word`` whose longest run is one word longer than that of ``state``."""
        target = self.nexts[state][word]
        if self.lengths[target] == self.lengths[state] + 1:
            return target
        clone = self._new(self.lengths[state] + 1, dict(self.nexts[target]), self.links[target])
        self.links[target] = clone
        while state >= 0 and self.nexts[state].get(word) == target:
            self.nexts[state][word] = clone
            state = self.links[state]
        return clone

    def _extended(self, last: int, word: bytes) -> int:
        if word in self.nexts[last]:
            return self._split(last, word)
        new = self._new(self.lengths[last] + 1, {}, 0)
        while last >= 0 and word not in self.nexts[last]:
            self.nexts[last][word] = new
            last = self.links[last]
        if last >= 0:
            self.links[new] = self._split(last, word)
        return new

    def _mark(self, item: str, words: list[bytes], size: int) -> None:
        state = 0
        for i, word in enumerate(words):
            state = self.nexts[state][word]
            while self.lengths[self.links[state]] >= size:
                state = self.links[state]
            if i + 1 >= size:
                self.ends.setdefault(state, {}).setdefault(size, set()).add(item)

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of matched words, as (first, last + 1) in order of their ends, and the items matched."""
        nexts, links, lengths, nearest, ends, least = self.nexts, self.links, self.lengths, self.nearest, self.ends, self.least
        spans, items = [], set()
        state = length = 0
        for i, word in enumerate(words):
            target = nexts[state].get(word)
            while target is None and state:
                state = links[state]
                length = lengths[state]
                target = nexts[state].get(word)
            if target is None:
                continue
            state = target
            length += 1
            if length < least:
                continue
            end = nearest[state]
            longest = 0
            while end:
                for size, whose in ends[end].items():
                    if size <= length:
                        longest = max(longest, size)
                        items |= whose
                end = nearest[links[end]]
            if longest:
                spans.append((i + 1 - longest, i + 1))
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


# The last automaton of a worker: it serves many tasks of one block.
_built: dict[str, SuffixAutomaton] = {}


def _automaton(block: Broadcast, window: int) -> SuffixAutomaton:
    name, items = block.value
    if name not in _built:
        _built.clear()
        _built[name] = SuffixAutomaton(items, window)
    return _built[name]


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks, in one pass: the driver holds a block and a partition of items at a time. The last block may be empty."""
    rows = items.where("item_id is not null and item_text is not null")
    rows = rows.select(F.col("item_id").cast("string").alias("item_id"), "item_text").distinct()
    block, size = [], 0
    for row in rows.toLocalIterator():
        words = words_of(row["item_text"])
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        if words:
            block.append((row["item_id"], words))
            size += len(words)
    yield block


def find_matches(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    blocks_at_once: int = BLOCKS_AT_ONCE,
) -> DataFrame:
    """``doc_id, text, n_words, spans, items`` per row of ``docs``: spans of hit words (first, behind the last), ids of the items."""
    spark = docs.sparkSession
    out = docs.select(
        quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), F.lit(0).alias("n_words"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items")
    )
    id_type = out.schema["doc_id"].dataType.simpleString()
    named = items.select(quoted(item_id).alias("item_id"), quoted(item_text).alias("item_text"))
    in_use: list[Broadcast] = []
    for block in _blocks(named, block_words):
        if len(in_use) == blocks_at_once:
            out = staged(out)
            while in_use:
                in_use.pop().destroy()
        shared = spark.sparkContext.broadcast((uuid4().hex, block))
        in_use.append(shared)

        def matched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared, window)
            for batch in batches:
                n_words, spans, found = [], [], []
                for words_text, old_spans, old_items in zip(batch["text"], batch["spans"], batch["items"], strict=True):
                    words = words_of(words_text.as_py())
                    new_spans, new_items = automaton.matches(words)
                    n_words.append(len(words))
                    old = [(s["start"], s["end"]) for s in old_spans.as_py()] if len(old_spans) else []
                    spans.append([{"start": a, "end": b} for a, b in merged(old + new_spans)])
                    found.append(sorted(new_items.union(old_items.as_py())) if len(old_items) else sorted(new_items))
                results = pa.array(n_words, pa.int32()), pa.array(spans, batch["spans"].type), pa.array(found, batch["items"].type)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], *results], names=batch.schema.names)

        out = out.mapInArrow(matched, f"doc_id {id_type}, text string, n_words int, {_MATCHES}")
    return out


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def is_contaminated(hits: Column, words: Column, share: int = SHARE) -> Column:
    return (hits > 0) & (hits * share >= words)


def without_spans(text: str | None, spans: list[tuple[int, int]], least: int = 1) -> str | None:
    """``text`` without its spans of ``least`` words or more; what stands between two words of a span goes with it."""
    if not text or not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text.translate(_ASCII_LOWER))]
    kept, behind = [], 0
    for start, end in spans:
        if end - start >= least:
            kept.append(text[behind : places[start][0]])
            behind = places[end - 1][1]
    return "".join([*kept, text[behind:]])


_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def remove_matches(matches: DataFrame, longest: int = WINDOW, share: int = SHARE) -> DataFrame:
    """``doc_id, text`` of :func:`find_matches`, without contaminated documents and, in the others, without spans of ``longest`` words or more."""
    clean = matches.where(~is_contaminated(n_hit(F.col("spans")), F.col("n_words"), share)).select("doc_id", "text", "spans")
    id_type = clean.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True)
            texts = [without_spans(t, [(s["start"], s["end"]) for s in spans], longest) for t, spans in rows]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return clean.mapInArrow(cut, f"doc_id {id_type}, text string")


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", share: int = SHARE) -> DataFrame:
    """The clean rows of ``docs``, each judged by itself whatever its id."""
    # The other columns travel as one, under names that any schema can have.
    others = [c for c in docs.columns if c != text]
    row = F.struct(F.lit(0).alias("c"), *(quoted(c).alias(f"c{k}") for k, c in enumerate(others)))
    matches = find_matches(docs.select(row.alias("row"), quoted(text).alias("text")), items, doc_id="row")
    clean = matches.where(~is_contaminated(n_hit(F.col("spans")), F.col("n_words"), share))
    place = {c: F.col(f"doc_id.c{k}") for k, c in enumerate(others)} | {text: F.col("text")}
    return clean.select(*(place[c].alias(c) for c in docs.columns))
