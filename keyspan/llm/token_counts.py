"""Token counts by a linear longest-match automaton (operator 7).

Word pieces are taken greedily, the longest first. A trie holds the pieces that begin a word and those that go on
within one. Every node knows where to fail to - the node for what is left after the pieces that longest match would
take from its string - and how many pieces those are. One step per byte then gives the length of a word's encoding; no
piece is ever built.

Words are runs without ``[\\x20\\x09-\\x0D]``. A word no pieces make up counts as one token.

Defined cases: null and empty texts have no words and no tokens. Repeated ids are counted row by row. Other columns
are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from keyspan.operators.frames import quoted

# Lengths of words that a Python worker remembers; then it starts afresh.
REMEMBERED = 200_000


class LongestMatch:
    """``begin`` pieces may start a word, ``inner`` pieces go on within one."""

    def __init__(self, begin: set[bytes], inner: set[bytes]):
        self.next: dict[int, int] = {}  # node * 256 + byte
        self.fail, self.popped = [-1, -1], [0, 0]  # the two roots: 0 begins a word, 1 goes on
        ends = [False, False]
        for root, pieces in enumerate((begin, inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    child = self.next.get(node << 8 | byte)
                    if child is None:
                        child = len(self.fail)
                        self.next[node << 8 | byte] = child
                        self.fail.append(-1)
                        self.popped.append(0)
                        ends.append(False)
                    node = child
                ends[node] = node > 1
        children: dict[int, list[tuple[int, int]]] = {}
        for key, child in self.next.items():
            children.setdefault(key >> 8, []).append((key & 255, child))
        waiting = deque([0, 1])
        while waiting:
            node = waiting.popleft()
            for byte, child in children.get(node, ()):
                waiting.append(child)
                if ends[child]:
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                at, count = self.fail[node], self.popped[node]
                while at >= 0 and (at << 8 | byte) not in self.next:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.next[at << 8 | byte], count

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; 1 if it has no greedy encoding, 0 if it is empty."""
        following, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for byte in word:
            while (child := following.get(node << 8 | byte)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = child
        while node > 1:
            total += popped[node]
            node = fail[node]
        return total if node >= 0 else 1


def byte_pieces(path: str) -> tuple[set[bytes], set[bytes]]:
    """The pieces of a byte-level vocabulary file: those with the space that begins a word, without it, and those without."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    # The printable characters stand for themselves, the other bytes for the characters from 256 on.
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    begin, inner = set(), set()
    for token in vocabulary:
        if all(c in byte_of for c in token):
            piece = bytes(byte_of[c] for c in token)
            if piece[:1] == b" " and len(piece) > 1:
                begin.add(piece[1:])
            elif piece.strip():
                inner.add(piece)
    return begin | {p for p in inner if len(p) == 1}, inner


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(*byte_pieces(path))


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` per row of ``docs``."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = automaton(path)
        known: dict[bytes, int] = {}
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch["text"]:
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if len(known) > REMEMBERED:
                    known.clear()
                total = 0
                for word in words:
                    n = known.get(word)
                    if n is None:
                        n = match.count(word)
                        if len(word) <= 64:
                            known[word] = n
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
            columns = [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_tokens"])

    return rows.mapInArrow(counted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
