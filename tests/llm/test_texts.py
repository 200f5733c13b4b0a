"""Quality, decontamination, byte-pair coding, token counts, lines and sentences."""

import re
import string
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyspan.llm import bpe, quality, span_dedup, token_counts
from keyspan.llm.decontaminate import SuffixAutomaton, find_matches, is_contaminated, merged, n_hit, remove_matches, without_spans, words_of
from keyspan.llm.line_spread import remove_boilerplate
from keyspan.llm.span_dedup import remove_repeated_spans, sentences
from tests.llm.fixtures import LONG, ODD_TEXTS, no_documents, odd_documents, prose

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# Quality


def test_features_of_any_text():
    for text in (None, "", " \n", "x", LONG, "é" * 9, "!!! ???", "\ud800"):
        found = quality.text_features(text)
        assert len(found) == len(quality.FEATURES) and np.isfinite(found).all()


def test_additive_model_learns_an_interaction():
    draw = np.random.default_rng(1)
    x = draw.random((4000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_additive(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert (0, 1) in model.pair_tables
    assert (quality.AdditiveModel().score(x) == 0.5).all()
    one = quality.fit_additive(np.zeros((5, 3)), np.ones(5))
    assert one.score(np.zeros((1, 3)))[0] > 0.5


def test_quality_held_out(spark):
    good = [(i, prose(i, 40)) for i in range(150)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 40).split())) for i in range(150)]
    docs = odd_documents(spark, good + bad + ODD_TEXTS[3:6] + [(None, "no id")])
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(0, 0), (None, 1), (3, None), (5, 1), (5, 1)], "doc_id long, quality int")
    model = quality.train_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == len(good) + len(bad) + 4
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] not in (4, 5, 6)]
    assert held and np.mean([r["predicted"] == (r["doc_id"] < 1000) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(not r["held_out"] for r in rows if r["doc_id"] is None)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i, _ in good[10:]}
    assert quality.score_quality(no_documents(spark), quality.train_quality(no_documents(spark), labels.limit(0))).count() == 0


# Decontamination


def brute_matches(items, words, window=13):
    hit, whose = set(), set()
    for item, own in items:
        size = min(window, len(own))
        runs = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1):
            if size and tuple(words[k : k + size]) in runs:
                hit |= set(range(k, k + size))
                whose.add(item)
    return hit, whose


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 5))
def test_automaton_finds_what_brute_force_finds(items, words, window):
    named = [(str(k), [w.encode() for w in item]) for k, item in enumerate(items)]
    raw = [w.encode() for w in words]
    spans, whose = SuffixAutomaton([i for i in named if i[1]], window).matches(raw)
    covered = {k for a, b in merged(spans) for k in range(a, b)}
    assert (covered, whose) == brute_matches(named, raw, window)


def test_matches_in_blocks_and_odd_documents(spark):
    test = prose(90, 60)
    items = [(1, test), (2, "Short one"), (2, "short ONE"), (3, None), (4, "..."), (None, "two words"), (10, prose(91, 30))]
    texts = ODD_TEXTS + [(50, "before " + test[:200] + " after"), (51, "a short-one here"), (52, test), (53, prose(93, 400) + " short one")]
    docs = odd_documents(spark, texts)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    known = [(str(i), words_of(t)) for i, t in items if i is not None and words_of(t)]
    for block_words, at_once in ((10**6, 3), (20, 3), (1, 1), (1, 2)):
        found = find_matches(docs, benchmark, block_words=block_words, blocks_at_once=at_once).collect()
        assert len(found) == len(texts)
        for r in found:
            hit, whose = brute_matches(known, words_of(r["text"]))
            assert {k for s in r["spans"] for k in range(s["start"], s["end"])} == hit and r["items"] == sorted(whose)
            assert r["n_words"] == len(words_of(r["text"]))
    judged = find_matches(docs, benchmark).withColumn("bad", is_contaminated(n_hit(F.col("spans")), F.col("n_words")))
    assert {r["doc_id"] for r in judged.where("bad").collect()} == {50, 51, 52}
    left = {r["doc_id"]: r["text"] for r in remove_matches(find_matches(docs, benchmark), longest=1).collect()}
    assert 50 not in left and left[53].endswith(". ") and left[12] == prose(3, 80)
    assert find_matches(no_documents(spark), benchmark).count() == 0
    assert find_matches(docs, benchmark.limit(0)).where("size(spans) > 0").count() == 0


def test_spans_are_cut_out_of_the_text():
    assert without_spans("One, two THREE-four.", [(1, 3)]) == "One, -four."
    assert without_spans("One, two", [(0, 1)], least=2) == "One, two" and without_spans(None, []) is None


# Byte-pair coding


def library(text):
    return bpe.coder(VOCABULARY).tokenizer.encode(text, add_special_tokens=False).ids


ANY = st.text(alphabet=st.sampled_from("aab b'stre  \n\n1.!é東<|endoftext|>"), max_size=400)


@settings(max_examples=250, deadline=None)
@given(ANY, ANY, st.integers(1, 6))
def test_joins_are_exact(a, b, times):
    code = bpe.coder(VOCABULARY)
    a, b = a * times, b * times
    _, ids = code.joined((a.encode(), library(a)), (b.encode(), library(b)))
    assert ids == library(a + b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "longer", "x", "'s", " ", "\n", "12", "<|endoftext|>", "é", "..."]), min_size=50, max_size=600), st.integers(20, 90))
def test_pieces_give_the_whole(parts, size):
    text = "".join(parts)
    cuts = bpe.pieces(text, size)
    assert "".join(t for _, t in cuts) == text and cuts[0][0]
    code, ids, run = bpe.coder(VOCABULARY), [], []
    for sure, part in cuts:
        if sure and run:
            ids += code.tree(run)[1]
            run = []
        run.append((part.encode(), library(part)))
    assert ids + code.tree(run)[1] == library(text)


def test_encoding_of_odd_documents(spark):
    docs = odd_documents(spark)
    texts = Counter((i, t or "") for i, t in ODD_TEXTS)
    for long in (60_000, 500):
        encoded = bpe.encode(docs, VOCABULARY, long=long, piece=100 if long == 500 else 30_000)
        rows = encoded.collect()
        assert Counter((r["doc_id"], r["decoded"]) for r in rows) == texts
        assert all(r["ids"] == library(r["decoded"]) for r in rows)
    assert Counter((r["doc_id"], r["text"]) for r in bpe.decode(encoded, VOCABULARY).collect()) == texts
    assert bpe.encode(no_documents(spark), VOCABULARY, digests=True).collect() == []


# Token counts


def greedy(word, begin, inner):
    n, at, pieces = 0, 0, begin
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        n, at, pieces = n + 1, end, inner
    return n


PIECES = st.sets(st.text("abc", min_size=1, max_size=5).map(str.encode), max_size=12)


@settings(max_examples=300, deadline=None)
@given(PIECES, PIECES, st.lists(st.text("abcd", max_size=12).map(str.encode), max_size=8))
def test_longest_match_counts(begin, inner, words):
    match = token_counts.LongestMatch(begin, inner)
    for word in words:
        assert match.count(word) == greedy(word, begin, inner)


def test_token_counts_of_odd_documents(spark):
    begin, inner = token_counts.byte_pieces(VOCABULARY)
    longest = max(map(len, begin | inner))

    def count(word):
        n, at, pieces = 0, 0, begin
        while at < len(word):
            end = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces)
            n, at, pieces = n + 1, end, inner
        return n

    found = Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts.count_tokens(odd_documents(spark), VOCABULARY).collect())
    words = [(i, (t or "").encode().split()) for i, t in ODD_TEXTS]
    assert found == Counter((i, len(w), sum(map(count, w))) for i, w in words)
    assert token_counts.count_tokens(no_documents(spark), VOCABULARY).collect() == []


# Lines


def test_boilerplate_lines(spark):
    rows = [(k, f"own line {k}\n  Shared   footer \n\nlocal", f"s{k}") for k in range(12)]
    rows += [(100 + k, f"Shared footer\nfew sites {k}\nsame site line", "one") for k in range(30)]
    rows += [(200 + k, "near line\nx", f"s{k}") for k in range(8)] + [(300 + k, "below line", f"s{k}") for k in range(7)]
    rows += [(400, None, "a"), (401, "", None), (402, "Shared footer", None), (402, "Shared footer", None), (None, "no id\nShared footer", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("line", F.lit(1))
    found = Counter((r["doc_id"], r["n_removed"], r["text"]) for r in remove_boilerplate(docs).collect())
    sites = {}
    clean = lambda line: " ".join(re.split(r"[\x20\x09-\x0D]+", line)).strip(" ")
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            sites.setdefault(clean(line), set()).add(site)
    gone = {line for line, whose in sites.items() if line and len(whose) >= 8}
    assert {"Shared footer", "near line", "local"} <= gone and "below line" not in gone
    want = Counter()
    for i, text, _ in rows:
        lines = None if text is None else text.split("\n")
        kept = None if lines is None else [x for x in lines if clean(x) not in gone]
        want[i, 0 if lines is None else len(lines) - len(kept), None if lines is None else "\n".join(kept)] += 1
    assert found == want
    assert remove_boilerplate(docs.limit(0)).collect() == []


def test_lines_of_odd_documents(spark):
    rows = remove_boilerplate(odd_documents(spark)).collect()
    assert Counter(r["text"] for r in rows) == Counter(t for _, t in ODD_TEXTS)


# Sentences


def brute_cut(text):
    """(start, end, normal form) of the sentences, from the plain rule of cuts."""
    words = [m for m in re.finditer(r"\S+", text or "")]
    plain = [m.group() for m in words]
    bounds = brute_bounds(plain) if len(words) >= 10 else [0, len(words)] if words else []
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    return [(words[a].start(), words[b - 1].end(), " ".join(plain[a:b]).translate(lower)) for a, b in zip(bounds, bounds[1:], strict=False)]


def brute_spans(rows, span=3):
    """(id, sentences, removed ones, text) of rows (id, text)."""
    cut = {(i, t): brute_cut(t) for i, t in rows}
    first = {}
    for i, t in sorted(cut, key=lambda r: (r[0] is not None, r[0] or 0)):
        forms = [form for _, _, form in cut[i, t]]
        for k in range(len(forms) - span + 1):
            first.setdefault(tuple(forms[k : k + span]), (i, t, k))
    out = []
    for i, t in rows:
        starts, forms = [s for s, _, _ in cut[i, t]], [form for _, _, form in cut[i, t]]
        gone = {k + j for k in range(len(forms) - span + 1) if first[tuple(forms[k : k + span])] != (i, t, k) for j in range(span)}
        if gone:
            ends = [*starts[1:], len(t)]
            t = (t[: starts[0]] + "".join(t[a:b] for k, (a, b) in enumerate(zip(starts, ends, strict=True)) if k not in gone)).rstrip()
        out.append((i, len(forms), len(gone), t))
    return out


# One run in so many is looked up where it is: none, all of a small table.
@pytest.mark.parametrize("hot", [1, 1000])
def test_repeated_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(span_dedup, "HOT", hot)
    passage = prose(70, 55)
    rows = [(21, prose(71, 90) + "\n" + passage + "\n" + prose(72, 30)), (22, passage + " " + prose(73, 60)), (23, prose(74, 40) + " " + passage.upper())]
    rows += [(24, prose(75, 60)), (25, "Yes. No. Yes. No. Yes. No."), (26, passage + " " + passage)] + ODD_TEXTS[:12] + ODD_TEXTS[13:15]
    docs = odd_documents(spark, rows)
    found = [(r["doc_id"], r["n_sentences"], r["n_removed"], r["text"]) for r in remove_repeated_spans(docs).collect()]
    assert Counter(found) == Counter(brute_spans(rows))
    texts = {r[0]: r[3] for r in found}
    assert passage in texts[21] and texts[24] == prose(75, 60) and texts[25] == "Yes. No. Yes. No. Yes. No."
    inner = " ".join(passage.split()[9:45])
    assert all(inner.lower() not in texts[k].lower() for k in (22, 23, 26))
    assert remove_repeated_spans(no_documents(spark)).collect() == []


@pytest.mark.parametrize("text", [LONG, "no stop at all " * 60, "a.\nb.\n\nc d e f g h. i", "  x  ", "Öö! ß? “Q.” z"])
def test_sentences_cover_the_text(text):
    cut = sentences(text)
    assert all(a[1] <= b[0] and not text[a[1] : b[0]].strip() for a, b in zip(cut, cut[1:], strict=False))
    assert not text[: cut[0][0]].strip() and not text[cut[-1][1] :].strip()


def test_long_sentences_are_cut_alike_wherever_they_stand():
    long = " ".join(prose(80, 200, capitals=False).replace(".", "").split())
    forms = lambda t: {f for _, _, f in sentences(t)}
    assert len(forms(long) & forms("some other words before it here " + long)) > 8


def brute_bounds(words, least=5):
    """Cuts by rank, each unless a taken one is near, without any arrays."""
    mix = [int(x) for x in span_dedup._MIX]
    forms = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in words]
    marks = [crc32(f.encode("utf-8", "surrogatepass")) for f in forms]
    ranks = []
    for p in range(least, len(words) - least + 1):
        end = re.search(r"[.!?。！？…][\"')\]}»”’]*$", words[p - 1])
        ranks.append((not end, ((marks[p - 1] * mix[0] ^ marks[p] * mix[1]) * mix[2]) % 2**64 >> 1, p))
    taken = []
    for _, _, p in sorted(ranks):
        if all(abs(p - q) >= least for q in taken):
            taken.append(p)
    return [0, *sorted(taken), len(words)]


def lines_of(words, n):
    return "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n))


SHORT = {
    "lines": lambda w: lines_of(w, 4),
    "a word a line": lambda w: "\n".join(w),
    "shouted": lambda w: " ".join(x.upper() + "!!" for x in w),
    "short sentences": lambda w: " ".join(x + "." * (k % 4 == 3) for k, x in enumerate(w)),
    "no marks": lambda w: " ".join(w),
    "quoted": lambda w: " ".join(f"“{x}É.”" if k % 3 else x for k, x in enumerate(w)),
}


def plain(seed, n):
    return prose(seed, n, capitals=False).replace(".", "").split()


@pytest.mark.parametrize("shape", SHORT)
def test_short_lines_and_short_sentences_are_cut(shape):
    text = SHORT[shape](plain(81, 400))
    bounds = brute_bounds(text.split())
    assert [len(form.split()) for _, _, form in sentences(text)] == [b - a for a, b in zip(bounds, bounds[1:], strict=False)]
    assert all(5 <= len(form.split()) <= 9 for _, _, form in sentences(text))


def test_copies_of_short_lines_go(spark):
    rows = []
    for k, shape in enumerate(SHORT.values()):
        passage = shape(plain(100 + k, 60))
        rows += [(10 * k, shape(plain(200 + k, 30)) + "\n" + passage), (10 * k + 1, passage + "\n" + shape(plain(300 + k, 45))), (10 * k + 2, passage)]
    found = [(r["doc_id"], r["n_sentences"], r["n_removed"], r["text"]) for r in remove_repeated_spans(odd_documents(spark, rows)).collect()]
    assert Counter(found) == Counter(brute_spans(rows))
    gone = {i: n for i, _, n, _ in found}
    assert all(gone[10 * k] == 0 and gone[10 * k + 1] >= 4 and gone[10 * k + 2] >= 4 for k in range(len(SHORT)))


@pytest.mark.parametrize("shape", [lambda w: w, lambda w: [x.strip(".") for x in w], lambda w: [x + "!!" for x in w], lambda w: w[:7] * 20])
def test_a_passage_of_51_words_has_a_run_wherever_it_starts(shape):
    text = shape(prose(82, 300).split())
    hosts = [shape(prose(83, 90).split()), prose(84, 90).split()]
    for begin in range(len(text) - 51):
        passage = text[begin : begin + 51]
        places = begin % 37, begin % 29 + 40
        first, second = (set(span_dedup._cut(" ".join(h[:k] + passage + h[k:]), 3)[1]) for h, k in zip(hosts, places, strict=True))
        assert first & second
    assert not set(span_dedup._cut(" ".join(hosts[0]), 3)[1]) & set(span_dedup._cut(" ".join(hosts[1]), 3)[1])


def test_lines_of_very_long_texts(spark):
    import time

    common = [f"line number {k} of them all" for k in range(0, 100_000, 2)]
    own = [f"own {k}" for k in range(100_000)]
    whole = "\n".join(common[k // 2] if k % 2 == 0 else own[k] for k in range(100_000))
    rows = [(1, whole, "s0")] + [(10 + k, "\n".join(common), f"s{k}") for k in range(1, 9)] + [(50, "x\n\nline number 0 of them all", "s1"), (51, "", "s1"), (52, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    began = time.monotonic()
    found = {r["doc_id"]: r for r in remove_boilerplate(docs).collect()}
    assert time.monotonic() - began < 60
    assert found[1]["n_lines"] == 100_000 and found[1]["n_removed"] == 50_000 and found[1]["text"] == "\n".join(own[1::2])
    assert all(found[10 + k]["text"] == "" and found[10 + k]["n_removed"] == 50_000 for k in range(1, 9))
    assert found[50]["text"] == "x\n" and found[51]["text"] == "" and found[52]["text"] is None
