"""Cross-tokenizer alignment against plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from keyspan.llm.token_alignment import Aligner, align, groups_and_links, least_hot, pair_counts, aligned, score_alignment
from keyspan.llm.vocabularies import byte_vocabulary, piece_vocabulary
from tests.llm.fixtures import ODD_TEXTS, no_documents, odd_documents

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")


def brute_groups(ends_a, ends_b):
    common = sorted(set(ends_a) & set(ends_b))
    return [ends_a.index(e) + 1 for e in common], [ends_b.index(e) + 1 for e in common]


def brute_links(ends_a, ends_b):
    starts_a, starts_b = [0, *ends_a][:-1], [0, *ends_b][:-1]
    return {
        (i, j)
        for i, (s, e) in enumerate(zip(starts_a, ends_a, strict=True))
        for j, (t, f) in enumerate(zip(starts_b, ends_b, strict=True))
        if max(s, t) < min(e, f)
    }


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.lists(st.integers(1, 3), max_size=60))
def test_groups_and_links_of_any_ends(sizes_a, sizes_b):
    a, b = np.cumsum(sizes_a, dtype=np.int64).tolist(), np.cumsum(sizes_b, dtype=np.int64).tolist()
    last = max(a[-1:] + b[-1:], default=0)
    a, b = (x if not last or x[-1:] == [last] else [*x, last] for x in (a, b))
    group_a, group_b, link_a, link_b = groups_and_links(np.array(a, np.int64), np.array(b, np.int64))
    assert (group_a.tolist(), group_b.tolist()) == brute_groups(a, b)
    links = list(zip(link_a.tolist(), link_b.tolist(), strict=True))
    assert len(links) == len(set(links)) and set(links) == brute_links(a, b)


def test_long_stretches_take_few_comparisons():
    class Counting(list):
        looked = 0

        def __getitem__(self, at):
            Counting.looked += 1
            return list.__getitem__(self, at)

    same = list(range(1, 100_001))
    stretch, length, *rest = align(same, same)
    assert (stretch, length) == ([0], [100_000]) and not any(rest)
    # One irregular group in the middle: two stretches, and the shift is one from there on.
    other = same[:50_000] + same[50_001:]
    assert align(same, other) == ([0, 50_002], [50_000, 49_998], [50_000], [50_000], [50_002], [50_001])
    assert align([], []) == ([], [], [], [], [], [])


def brute(texts):
    a, b = byte_vocabulary(A), piece_vocabulary(B)
    docs, holders = [], defaultdict(set)
    for k, text in enumerate(texts):
        left, right = (a.encode(" " + text), b.encode([text])[0]) if text else ([], [])
        raw = b" " + (text or "").encode()
        if b"".join(a.table[t] for t in left) != raw or b"".join(b.table[t] for t in right) != raw:
            left, right = [], []
        ends_a, ends_b = ([sum(len(v.table[t]) for t in ids[: n + 1]) for n in range(len(ids))] for v, ids in ((a, left), (b, right)))
        links = [(left[i], right[j]) for i, j in brute_links(ends_a, ends_b)]
        groups, at = [], (0, 0)
        for end in zip(*brute_groups(ends_a, ends_b), strict=True):
            groups.append(",".join(map(str, left[at[0] : end[0]])) + "|" + ",".join(map(str, right[at[1] : end[1]])))
            at = end
        docs.append((left, right, links, groups))
        for pair in links:
            holders[pair].add(k)
    counts = {pair: len(rows) for pair, rows in holders.items()}
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    return [
        (len(x), len(y), len(g), len(ls), sum(counts[p] == highest[p[0]] for p in ls), sum(counts[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for x, y, ls, g in docs
    ]


SHORT = ["a▁b", " lead", "<s> <unk> <|endoftext|>", "\x00", "don't  stop\n\n\tnow", "naïve 東京 😀 ꙮ", "#" * 300, "x" * 200, " ", "﻿", "word " * 40]
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_rows(spark, tmp_path):
    draw = random.Random(5)
    texts = [(i, t if t is None else t[:300]) for i, t in ODD_TEXTS]
    texts += [(100 + k, t) for k, t in enumerate(SHORT)] + [(500 + k, " ".join(draw.choices("of the taken tokens unhappily Straße 12345 x".split(), k=30))) for k in range(20)]
    want = Counter((i, *row) for (i, _), row in zip(texts, brute([t for _, t in texts]), strict=True))
    assert sum(row[1] == 0 for row in want) >= 3
    docs = odd_documents(spark, texts)
    for hot in (1 << 20, 40, 0):
        rows = score_alignment(docs, A, B, hot=hot).collect()
        assert Counter((r["doc_id"], *(r[n] for n in NAMES)) for r in rows) == want
    assert score_alignment(no_documents(spark), A, B).collect() == []
    assert score_alignment(no_documents(spark), A, B, hot=0).columns == ["doc_id", *NAMES]


def test_bound_of_common_pairs(spark):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([1] * 10 + [5] * 3 + [900, 1000])], "pair long, n long")
    for hot, kept in ((100, 15), (14, 5), (5, 5), (4, 2), (1, 1), (0, 0)):
        assert counts.where(f"n >= {least_hot(counts, hot)}").count() == kept
    found = aligned(odd_documents(spark, [(1, "of the"), (2, "of"), (3, "of of")]), A, B)
    assert sorted(r["n"] for r in pair_counts(found).collect()) == [1, 3]


def test_batches_of_texts_are_independent():
    aligner = Aligner(byte_vocabulary(A), piece_vocabulary(B))
    together = aligner.rows(SHORT)
    for k, text in enumerate(SHORT):
        alone = aligner.rows([text])
        assert all(alone[name][0].as_py() == column[k].as_py() for name, column in together.items())
