"""Documents that are hard to get right, with columns named like an operator's own."""

from __future__ import annotations

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so", "ven") for b in ("n", "r", "sta", "mo", "x", "ing", "ble")]


def prose(seed: int, n: int, capitals: bool = True) -> str:
    draw = random.Random(seed)
    words, out = [draw.choice(WORDS) + draw.choice(WORDS) for _ in range(n)], []
    for k in range(0, n, 9):
        sentence = " ".join(words[k : k + 9]) + "."
        out.append(sentence.capitalize() if capitals else sentence)
    return " ".join(out)


LONG = prose(1, 6000)
BASE = prose(2, 120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)

ODD_TEXTS = [
    (1, BASE),
    (2, NEAR),
    (3, BASE.upper().replace(" ", "\n\t ")),
    (4, None),
    (5, ""),
    (6, " \t\n"),
    (7, "two words"),
    (8, "Two  words"),
    (9, LONG),
    (10, LONG + " tail"),
    (11, "x" * 50_000),
    (12, prose(3, 80)),
    (12, prose(3, 80)),
    (13, prose(4, 80)),
    (13, "the same id with another text altogether, of a few words"),
    (None, "no id at all"),
    (14, "Ünïcödé straße 東京 \u00a0 mixed " * 8),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, slot int, _folder string, kept string, n int, `a.b` int"


def odd_documents(spark, rows=None):
    return spark.createDataFrame(
        [(i, t, None, f"site{k % 3}" if k % 5 else None, None, k, "x", "y", None, k) for k, (i, t) in enumerate(ODD_TEXTS if rows is None else rows)], COLUMNS
    )


def no_documents(spark):
    return odd_documents(spark, [])
