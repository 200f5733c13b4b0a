"""Quality rules against plain loops and libraries."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from keyspan.llm import fertility
from keyspan.llm.vocabularies import byte_vocabulary, piece_vocabulary
from tests.llm.fixtures import LONG, ODD_TEXTS, no_documents, odd_documents, prose

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    out = [""]
    for c in text:
        if c in SPACE:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def brute_repeats(words):
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times = Counter(windows)
    return len({k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(8)})


def brute_base(text):
    words = words_of(text or "")
    lines = [line for line in (text or "").split("\n") if words_of(line)]
    repeats = brute_repeats(words)
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        sum(line in lines[:k] for k, line in enumerate(lines)),
        repeats,
        len(words) < 20 or 100 * repeats > 30 * len(words),
    )


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=6))
def test_repeated_words(texts):
    words = np.array([w for text in texts for w in text], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    assert fertility.repeated_words(words, owner, len(texts)).tolist() == [brute_repeats(t) for t in texts]


HARD = ["", " ", "a\x0bb\x0cc\x1cd e", "x\n\n x\nx\n x\n", "#*$%&|<> " * 9, "東京 😀 ꙮ ሀ", "same eight words again and again for ever " * 4, LONG, "\n"]


def test_measures_of_texts():
    tokens, pieces = byte_vocabulary(A), piece_vocabulary(B)
    found = fertility.measured_texts(HARD, tokens, pieces)
    for k, text in enumerate(HARD):
        assert [found[name][k] for name in fertility.COUNTS[:5]] == list(brute_base(text)[:5])
        ids = tokens.tokenizer.encode(text, add_special_tokens=False).ids
        shares = [n / len(ids) for n in Counter(ids).values()]
        assert found["n_tokens"][k] == len(ids) and abs(found["entropy"][k] + sum(p * math.log2(p) for p in shares)) < 1e-9
        assert abs(found["chars_per_token"][k] - len(text) / max(len(ids), 1)) < 1e-12
        spelled = sum(map(pieces.pieces.is_byte, pieces.encode([text])[0]))
        assert abs(found["spelled_share"][k] - spelled / max(len(text.encode()), 1)) < 1e-12
    scripts = fertility.measured_texts(["abc é", "Привет a", "東京都", "ひらがな", "한국어", "123 !?", ""], tokens, pieces)["script"]
    assert scripts == ["latin", "cyrillic", "han", "kana", "hangul", "none", "none"]
    assert fertility.measured_texts([], tokens, pieces)["script"] == []


def test_rules_on_rows(spark):
    draw = random.Random(6)
    junk = [(5000 + k, " ".join(w.upper() + "!!" for w in prose(k, 60).split())) for k in range(15)]
    poor = [(6000 + k, " ".join(draw.choice(["ka", "lo", "mi"]) for _ in range(400))) for k in range(15)]
    clean = [(k, prose(k, 40 + 30 * (k % 4))) for k in range(100, 900)]
    docs = odd_documents(spark, clean + junk + poor + ODD_TEXTS + [(950 + k, t) for k, t in enumerate(HARD)])
    rows = fertility.quality_rules(docs, A, B).collect()
    assert Counter((r["doc_id"], *(r[n] for n in fertility.COUNTS[:5]), r["base_failed"]) for r in rows) == Counter(
        (i, *brute_base(t)) for i, t in clean + junk + poor + ODD_TEXTS + [(950 + k, t) for k, t in enumerate(HARD)]
    )
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert all(kept[i] for i, _ in clean)
    assert not any(kept[i] for i, _ in junk)
    assert not any(kept[i] for i in (4, 5, 6, 7))
    assert {r["language"] for r in rows} >= {"script latin", "script none"}
    assert all(r["kept"] == (not r["base_failed"] and not r["rejected_by"]) for r in rows)
    assert fertility.quality_rules(no_documents(spark), A, B).collect() == []
    # Too few documents make no band; a column of languages may be missing.
    few = fertility.quality_rules(odd_documents(spark, clean[:5] + junk[:5]), A, B, lang=None).collect()
    assert all(r["kept"] for r in few)


def test_bands_by_language(spark):
    rows = [(k, "de" if k % 2 else "en", 600, 2.0 + (k % 2) + 0.01 * (k % 7), 6.0, 0.0, False) for k in range(400)]
    rows += [(1000, "en", 600, 3.0, 6.0, 0.0, False), (1001, "de", 600, 3.0, 6.0, 0.0, False), (1002, "fr", 600, 3.0, 6.0, 0.0, False)]
    rows += [(1003, "en", 600, 2.0, 5.0, 0.0, False), (1004, "en", 600, 2.0, 6.0, 0.5, False), (1005, "en", 600, 2.0, 9.0, 0.0, True)]
    schema = "doc_id long, language string, n_tokens long, chars_per_token double, entropy double, spelled_share double, base_failed boolean"
    measured = spark.createDataFrame(rows, schema).selectExpr("*", "length(bin(n_tokens)) as length_class")
    judged = {r["doc_id"]: (r["rejected_by"], r["kept"]) for r in fertility.judge(measured, fertility.bands(measured)).collect()}
    assert len(judged) == len(rows) and all(judged[k] == ([], True) for k in range(400))
    assert judged[1000] == (["chars_per_token"], False) and judged[1001] == ([], True) and judged[1002] == ([], True)
    assert judged[1003] == (["entropy"], False) and judged[1004] == (["spelled_share"], False) and judged[1005] == ([], False)
