"""Quality rules by tokeniser fertility (operator 13).

How a public vocabulary takes a text tells prose from what merely looks like it. Per document: characters per token and the entropy of the
tokens in a byte-level vocabulary, and the share of bytes that a piece vocabulary has to spell one by one, since it lacks their
characters. What is usual differs by language, and entropy and its spread by length, so every language (every script where the language is
unknown) has bands per doubling of the number of tokens. A band reaches ``REACH`` interquartile ranges of all the documents of its group
beyond their quartiles on the rejected side; quartiles don't move with a minority of junk. Characters per token have a band
at both sides, entropy is only too low, the spelled share only too high. A group of fewer than ``LEAST`` documents has the bands of all
languages at its length, and where those are too few as well, nothing is rejected by bands.

Measures are cut to whole steps (``STEPS``) before quartiles are taken, so these are exact, mergeable counts of few values per group and
every run has the same bands.

The base rule comes first: a document fails with fewer than ``LEAST_WORDS`` words, or with over ``MOST_REPEATED`` percent of its words in
windows of ``WINDOW`` words that occur twice or more in it. Windows are compared exactly: words are numbered, then pairs, fours and
eights of neighbours.

Defined cases: a null or empty text, or one of white space, has no words, fails the base rule and is not kept; it takes no part in bands
if it has no tokens. A null or empty language counts as unknown. Rows that share an id, or have none, are judged one by one. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.staging import staged
from keyspan.llm.vocabularies import ByteVocabulary, PieceVocabulary, batches_of, byte_vocabulary, piece_vocabulary
from keyspan.operators.frames import quoted

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
# Interquartile ranges beyond the quartiles, and the least range, of each measure.
REACH = 4.0
LEAST_RANGE = {"chars_per_token": 0.05, "entropy": 0.1, "spelled_share": 0.01}
# Steps per unit that measures are cut to for the quartiles.
STEPS = {"chars_per_token": 256, "entropy": 256, "spelled_share": 4096}
# Documents that make a group.
LEAST = 100
AT_ONCE, CHARS_AT_ONCE = 256, 400_000

# First code point and script of ranges of letters, in order; what lies between belongs to the range before it. Fixed values.
SCRIPTS = (
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00C0, "latin"), (0x0250, "none"),
    (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2C00, "other"), (0x3000, "none"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "none"), (0xF900, "han"),
    (0xFB00, "none"), (0x20000, "han"), (0x32000, "none"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS} - {"none"})
_STARTS = np.array([first for first, _ in SCRIPTS])
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) if name != "none" else len(SCRIPT_NAMES) for _, name in SCRIPTS])

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
MEASURES = ("chars_per_token", "entropy", "spelled_share")


def repeated_words(words: np.ndarray, owner: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Per text, its words inside windows that it holds twice or more; ``words`` are numbers, ``owner`` their texts 0 to n - 1 in order.

    ``window`` is a power of two.
    """
    if len(words) < window:
        return np.zeros(n, np.int64)
    # A window that reaches into the next text holds the numbers of two texts in an order that occurs at that place alone.
    codes = pd.factorize(owner * (int(words.max()) + 1) + words)[0]
    width = 1
    while width < window:
        codes = pd.factorize(codes[:-width] * (int(codes.max()) + 1) + codes[width:])[0]
        width *= 2
    again = np.bincount(codes)[codes] > 1
    opened = np.concatenate([again, np.zeros(window - 1, bool)]).astype(np.int64)
    covering = np.cumsum(opened) - np.concatenate([np.zeros(window, np.int64), np.cumsum(opened)[:-window]])
    return np.bincount(owner, weights=covering > 0, minlength=n).astype(np.int64)


def measured_texts(texts: list[str], tokens: ByteVocabulary, pieces: PieceVocabulary) -> dict[str, np.ndarray | list[str]]:
    """All counts, measures and the script of each text."""
    n = len(texts)
    raw = [text.encode("utf-8", "surrogatepass") for text in texts]
    split = [text.split() for text in raw]
    n_words = np.array([len(words) for words in split], np.int64)
    numbers: dict[bytes, int] = {}
    words = np.array([numbers.setdefault(word, len(numbers)) for words in split for word in words], np.int64)
    n_chars = np.array([len(text) for text in texts], np.int64)
    spaces = np.array([len(text) - len(text.translate(None, SPACE)) for text in raw], np.int64)
    dup_lines = []
    for text in raw:
        lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
        dup_lines.append(len(lines) - len(set(lines)))
    ids = [tokens.encode(text) for text in texts]
    n_tokens = np.array([len(own) for own in ids], np.int64)
    keys = np.fromiter((k for own in ids for k in own), np.int64, n_tokens.sum())
    owner = np.repeat(np.arange(n), n_tokens)
    distinct, times = np.unique(owner * len(tokens.table) + keys, return_counts=True)
    own = distinct // len(tokens.table)
    # Entropy of counts c of n tokens: log n - sum of c log c / n.
    safe = np.maximum(n_tokens, 1)
    entropy = np.log2(safe) - np.bincount(own, weights=times * np.log2(times), minlength=n) / safe
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    reader = np.repeat(np.arange(n), n_chars)
    spelled = np.bincount(reader, weights=pieces.spelled[points], minlength=n)
    kinds = len(SCRIPT_NAMES) + 1
    script = _SCRIPT_OF[np.searchsorted(_STARTS, points, "right") - 1]
    per_script = np.bincount(reader * kinds + script, minlength=n * kinds).reshape(n, kinds)[:, :-1]
    return {
        "n_words": n_words,
        "word_chars": n_chars - spaces,
        "n_symbols": np.array([len(text) - len(text.translate(None, SYMBOLS)) for text in raw], np.int64),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": repeated_words(words, np.repeat(np.arange(n), n_words), n),
        "n_tokens": n_tokens,
        "chars_per_token": n_chars / safe,
        "entropy": np.maximum(entropy, 0.0),
        "spelled_share": spelled / np.maximum([len(text) for text in raw], 1),
        "script": [SCRIPT_NAMES[k] if most else "none" for k, most in zip(per_script.argmax(1), per_script.max(1), strict=True)],
    }


def measure(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """``doc_id, language``, the counts, the measures, ``base_failed`` and ``length_class`` per row of ``docs``."""
    language = quoted(lang).cast("string") if lang is not None else F.lit(None).cast("string")
    rows = docs.select(quoted(doc_id).alias("doc_id"), language.alias("language"), quoted(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pieces = byte_vocabulary(byte_path), piece_vocabulary(piece_path)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for start, end in batches_of(texts, AT_ONCE, CHARS_AT_ONCE):
                part = batch.slice(start, end - start)
                found = {name: pa.array(column) for name, column in measured_texts(texts[start:end], tokens, pieces).items()}
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["language"], *found.values()], names=["doc_id", "language", *found])

    counts, measures = (", ".join(f"{name} {kind}" for name in names) for names, kind in ((COUNTS, "long"), (MEASURES, "double")))
    found = rows.mapInArrow(of_batches, f"doc_id {id_type}, language string, {counts}, {measures}, script string")
    return found.select(
        "doc_id",
        F.coalesce(F.nullif(F.col("language"), F.lit("")), F.concat(F.lit("script "), "script")).alias("language"),
        "script",
        *COUNTS,
        *MEASURES,
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        F.length(F.bin("n_tokens")).alias("length_class"),
    )


def _bands(measured: DataFrame, *group: str) -> DataFrame:
    def quartiles(name: str) -> Column:
        return F.percentile(F.floor(F.col(name) * STEPS[name]), F.array(F.lit(0.25), F.lit(0.75))).alias(name)

    found = measured.where(F.col("n_tokens") > 0).groupBy(*group).agg(F.count("*").alias("n"), *map(quartiles, MEASURES))

    def edge(name: str, side: int) -> Column:
        low, high = F.col(name)[0] / STEPS[name], F.col(name)[1] / STEPS[name]
        reach = REACH * F.greatest(high - low, F.lit(LEAST_RANGE[name]))
        return low - reach if side < 0 else high + reach

    return found.where(F.col("n") >= LEAST).select(
        *group,
        edge("chars_per_token", -1).alias("least_chars"),
        edge("chars_per_token", 1).alias("most_chars"),
        edge("entropy", -1).alias("least_entropy"),
        edge("spelled_share", 1).alias("most_spelled"),
    )


def bands(measured: DataFrame) -> DataFrame:
    """The bands of every language and length class with enough documents; those of all languages have a null language."""
    everyone = _bands(measured, "length_class").withColumn("language", F.lit(None).cast("string"))
    return _bands(measured, "language", "length_class").unionByName(everyone)


EDGES = ("least_chars", "most_chars", "least_entropy", "most_spelled")


def judge(measured: DataFrame, known: DataFrame) -> DataFrame:
    """``measured`` with its edges, ``rejected_by`` (names of the measures outside their bands) and ``kept``."""
    own = known.where(F.col("language").isNotNull())
    everyone = known.where(F.col("language").isNull()).select("length_class", *(F.col(e).alias(f"any_{e}") for e in EDGES))
    rows = measured.join(own, ["language", "length_class"], "left").join(everyone, "length_class", "left")
    rows = rows.withColumns({e: F.coalesce(e, f"any_{e}") for e in EDGES})
    outside = F.array_compact(
        F.array(
            F.when((F.col("chars_per_token") < F.col("least_chars")) | (F.col("chars_per_token") > F.col("most_chars")), "chars_per_token"),
            F.when(F.col("entropy") < F.col("least_entropy"), "entropy"),
            F.when(F.col("spelled_share") > F.col("most_spelled"), "spelled_share"),
        )
    )
    return rows.withColumn("rejected_by", outside).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def quality_rules(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Per row of ``docs``: the counts, ``base_failed``, ``kept``, then language, script, measures and ``rejected_by``."""
    measured = staged(measure(docs, byte_path, piece_path, doc_id, text, lang))
    judged = judge(measured, staged(bands(measured)))
    return judged.select("doc_id", *COUNTS[:5], "base_failed", "kept", "n_tokens", "language", "script", *MEASURES, "rejected_by")
