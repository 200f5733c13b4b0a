"""Byte-pair encoding and decoding with tree concatenation (operator 6).

Most texts are encoded whole by a public tokenizer. A text of more than ``LONG`` characters is cut into pieces that
other tasks encode in parallel. A cut between a letter and a single space before a letter is a boundary of tokens in
any case; where a stretch has no such place, it is cut anywhere and its pieces are joined as a tree: tokens left and
right of the join are encoded again as one window, which grows until its first and last tokens are those that the two
sides have there.

Why that is exact: a token sequence is the encoding of its text if every two neighbours are the encoding of theirs.
Inside a side and inside the window all neighbours are, and where both share a token, so are those across. A window
doesn't begin with an apostrophe, the one character whose role depends on what stands before it, and holds ``EDGE``
bytes of either side, more than any added token.

Defined cases: null and empty texts have no tokens and decode to the empty text. Repeated ids are encoded row by row.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.staging import staged
from keyspan.llm.vocabularies import byte_of_character, ranked_encoder
from keyspan.operators.frames import quoted

LONG = 60_000
PIECE = 30_000
# Least bytes of a side in a window.
EDGE = 64
# Characters encoded at once: bounds what the library holds.
AT_ONCE = 400_000


class Coder:
    """A tokenizer file of byte-level BPE, as its library encodes and decodes, and the bytes of each token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        byte_of, whole = byte_of_character(), {token["id"] for token in added}
        self.table = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            # One character stands for one byte, but in added tokens.
            self.table[k] = token.encode() if k in whole or not all(c in byte_of for c in token) else bytes(map(byte_of.__getitem__, token))
        self.sizes = np.fromiter(map(len, self.table), np.int64, len(self.table))
        self.names = list(map(str, range(len(self.sizes))))
        # The same tokens from ranks, several times faster, where the file allows it: added tokens are plain strings, cut out first.
        plain = all(t["content"].isascii() and not any(t[f] for f in ("single_word", "lstrip", "rstrip", "normalized")) for t in added)
        self.ranked = ranked_encoder(path) if plain else None
        self.added = {token["content"]: token["id"] for token in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self._by_ranks(text) for text in texts]
        out: list[list[int]] = []
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= AT_ONCE):
                chars += len(texts[end])
                end += 1
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[start:end], add_special_tokens=False)]
            start = end
        return out

    def _by_ranks(self, text: str) -> list[int]:
        encode = self.ranked.encode_ordinary
        if not any(content in text for content in self.added):
            return encode(text)
        return [k for part in self.cut.split(text) for k in ([self.added[part]] if part in self.added else encode(part))]

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        try:
            return self.bytes_of(ids).decode("utf-8")
        except (UnicodeDecodeError, IndexError):
            # Ids that no text has: as the library replaces broken characters and leaves out unknown ids.
            return self.tokenizer.decode(ids, skip_special_tokens=False)

    def joined(self, left: tuple[bytes, list[int]], right: tuple[bytes, list[int]]) -> tuple[bytes, list[int]]:
        """The encoding of ``left`` and ``right``, each a text in UTF-8 with its tokens, as one text."""
        (a, x), (b, y) = left, right
        whole = a + b
        if not x or not y:
            return whole, x or y
        ends = np.cumsum(self.sizes[y])
        starts = len(a) - np.cumsum(self.sizes[x[::-1]])  # of the last, the last but one, ...
        size = EDGE
        while True:
            i = int(np.searchsorted(-starts, size - len(a)))
            while i < len(starts) and (_inside(whole, int(starts[i])) or whole[starts[i]] == 0x27):
                i += 1
            j = int(np.searchsorted(ends, size))
            while j < len(ends) and _inside(whole, len(a) + int(ends[j])):
                j += 1
            i, j = min(i + 1, len(x)), min(j + 1, len(y))
            first = 0 if i == len(x) else int(starts[i - 1])
            last = len(whole) if j == len(y) else len(a) + int(ends[j - 1])
            new = self.encode([whole[first:last].decode("utf-8")])[0]
            if (i == len(x) or new[0] == x[-i]) and (j == len(y) or new[-1] == y[j - 1]):
                return whole, x[: len(x) - i] + new + y[j:]
            size *= 2

    def tree(self, parts: list[tuple[bytes, list[int]]]) -> tuple[bytes, list[int]]:
        """Halves first, then their join."""
        if len(parts) == 1:
            return parts[0]
        middle = len(parts) // 2
        return self.joined(self.tree(parts[:middle]), self.tree(parts[middle:]))


def _inside(text: bytes, at: int) -> bool:
    """Whether a character goes on at this byte."""
    return at < len(text) and text[at] & 0xC0 == 0x80


@lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    return Coder(path)


def pieces(text: str, size: int = PIECE) -> list[tuple[bool, str]]:
    """``text`` in pieces of ``size`` characters or a few more; whether each begins at a sure boundary of tokens."""
    out, start, sure = [], 0, True
    while len(text) - start > 2 * size:
        end = start + size
        # Look for a sure boundary for as long as a piece is.
        at = text.find(" ", end, end + size)
        while at >= 0 and not (text[at - 1].isalpha() and text[at + 1 : at + 2].isalpha()):
            at = text.find(" ", at + 1, end + size)
        found = at >= 0
        end = at if found else end
        out.append((sure, text[start:end]))
        start, sure = end, found
    return [*out, (sure, text[start:])]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, finish) -> Iterator[pa.RecordBatch]:
    code = coder(path)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = [t or "" for t in part["text"].to_pylist()]
            yield finish(code, part, code.encode(texts))


def _digests(code: Coder, ids: list[int]) -> tuple[int, str, str]:
    names = code.names
    listed = ",".join([names[i] for i in ids])
    return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(code.bytes_of(ids)).hexdigest()


def _rows(code: Coder, first: pa.Array, all_ids: list[list[int]], whole: bool) -> pa.RecordBatch:
    if whole:
        columns = [pa.array(all_ids, pa.list_(pa.int32())), pa.array([code.decode(ids) for ids in all_ids], pa.string())]
        return pa.RecordBatch.from_arrays([first, *columns], names=["doc_id", "ids", "decoded"])
    n, ids, decoded = zip(*(_digests(code, ids) for ids in all_ids), strict=True) if all_ids else ((), (), ())
    columns = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
    return pa.RecordBatch.from_arrays([first, *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    digests: bool = False,
    long: int = LONG,
    piece: int = PIECE,
) -> DataFrame:
    """``doc_id, ids, decoded`` per row of ``docs``; with ``digests`` ``doc_id, n_tokens, ids_sha256, decoded_sha256`` instead."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, path, lambda code, part, ids: _rows(code, part["doc_id"], ids, not digests))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, whole in zip(batch["doc_id"], batch["row"], batch["text"], strict=True):
                cuts = pieces(whole.as_py(), piece)
                n = len(cuts)
                columns = [
                    pa.array([doc.as_py()] * n, batch["doc_id"].type),
                    pa.array([row.as_py()] * n, pa.int64()),
                    pa.array(range(n), pa.int32()),
                    pa.array([sure for sure, _ in cuts]),
                    pa.array([part for _, part in cuts], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "no", "sure", "text"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, path, lambda code, part, ids: part.append_column("ids", pa.array(ids, pa.list_(pa.int32()))))

    def together(table: pa.Table) -> pa.Table:
        code = coder(path)
        table = table.sort_by("no")
        ids: list[int] = []
        run: list[tuple[bytes, list[int]]] = []
        for sure, part, own in zip(table["sure"].to_pylist(), table["text"].to_pylist(), table["ids"].to_pylist(), strict=True):
            if sure and run:
                ids += code.tree(run)[1]
                run = []
            run.append((part.encode("utf-8", "surrogatepass"), own))
        ids += code.tree(run)[1]
        return pa.Table.from_batches([_rows(code, table["doc_id"].combine_chunks().slice(0, 1), [ids], not digests)])

    # The row's number keeps repeated ids apart; it is written, so a retried task finds the same.
    lengthy = staged(rows.where(F.length("text") > long).withColumn("row", F.monotonically_increasing_id()))
    parts = lengthy.mapInArrow(cut, f"doc_id {id_type}, row long, no int, sure boolean, text string")
    parts = parts.repartition("row", "no").mapInArrow(coded, f"doc_id {id_type}, row long, no int, sure boolean, text string, ids array<int>")
    joined = parts.groupBy("row").applyInArrow(together, schema)
    return rows.where(F.length("text") <= long).mapInArrow(short, schema).union(joined)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                decoded = [code.decode(ids or []) for ids in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(decoded, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, f"doc_id {id_type}, text string")
