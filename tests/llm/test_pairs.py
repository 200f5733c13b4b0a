"""Exact and near copies."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyspan.llm.components import connected
from keyspan.llm.exact_dedup import drop_duplicates, duplicate_groups, filter_bits
from keyspan.llm.jaccard import jaccard_components
from keyspan.llm.shingles import shingle_sets
from tests.llm.fixtures import LONG, no_documents, odd_documents, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_sets(text):
    words = WORD.findall((text or "").encode().lower())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_components(rows):
    """(id, size, component) of rows (id, text), comparing all pairs."""
    sets = [brute_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if None not in (rows[i][0], rows[j][0]) and ((shared and 100 * shared >= 75 * (len(a) + len(sets[j]) - shared)) or (same_id and a == sets[j])):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for k, (doc, _) in enumerate(rows):
        least[find(k)].append(doc)
    return [(doc, len(s), None if doc is None else min(least[find(k)])) for k, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def by_text(rows):
    return sorted(map(repr, rows))


def found_components(docs):
    return [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()]


def test_components_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert by_text(found_components(docs)) == by_text(brute_components(rows))
    assert found_components(no_documents(spark)) == []


def test_components_of_a_large_group_with_chains(spark):
    rows, k = [], 0
    draw = np.random.default_rng(3)
    for family in range(4):
        words = prose(20 + family, 70).split()
        for step in range(60):
            k += 1
            # Each copy differs from the last: ends of the chain are far apart, and some are just beside the threshold.
            words = words[:]
            words[int(draw.integers(len(words)))] = f"w{k}"
            rows.append((k, " ".join(words)))
    rows += [(1000 + i, f"shared opening line of many documents here. {prose(500 + i, 12)}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert by_text(found_components(docs)) == by_text(brute_components(rows))


def test_texts_of_one_id_have_links_of_their_own(spark):
    near = lambda seed, *places: " ".join(f"other{k}" if k in places else w for k, w in enumerate(prose(seed, 90).split()))
    rows = [(1, prose(600 + k, 90)) for k in range(4)]
    rows += [(10 + k, near(600 + k, 30)) for k in range(4)] + [(20 + k, near(600 + k, 60)) for k in range(4)]
    rows += [(30, prose(602, 90)), (1, prose(601, 90)), (1, prose(700, 90)), (40, prose(701, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = found_components(docs)
    assert by_text(found) == by_text(brute_components(rows))
    assert {c for i, _, c in found if i != 40} == {1}


def test_shingles_of_whole_texts():
    texts = ["a b c d e", "A  b\tc\nd e", "a b c d", "", None, LONG, "x y z z z z z z z z"]
    got = list(shingle_sets(texts))
    assert [len(s) for s in got] == [len(brute_sets(t)) for t in texts]
    assert got[0].tolist() == got[1].tolist() != got[2].tolist()


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, 50), (50, 70), (7, 200), (300, 300)]
    found = dict(map(tuple, connected(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {v for k, v in found.items() if k <= 30 or k == 200} == {1}
    assert {k: found[k] for k in (100, 50, 70)} == {100: 50, 50: 50, 70: 50} and 300 not in found


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups(spark):
    docs = odd_documents(spark, [(5, "a b"), (3, "a \n b"), (9, "A b"), (4, None), (2, ""), (None, "a b"), (7, "q"), (7, "q"), (8, "solo")])
    found = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in duplicate_groups(docs).collect()}
    sha = lambda t: hashlib.sha256(normal(t).encode()).hexdigest()
    assert found == {
        (5, 3, 3, False, sha("a b")), (3, 3, 3, True, sha("a b")), (None, 3, 3, False, sha("a b")), (9, 9, 1, True, sha("A b")),
        (4, 2, 2, False, sha("")), (2, 2, 2, True, sha("")), (7, 7, 2, True, sha("q")), (8, 8, 1, True, sha("solo")),
    }
    assert duplicate_groups(no_documents(spark)).collect() == []


def test_dropped_copies_keep_all_columns(spark):
    docs = odd_documents(spark)
    kept = drop_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [normal(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {normal(r["text"]) for r in docs.collect()}
    assert drop_duplicates(no_documents(spark)).count() == 0


def test_unique_rows_are_not_shuffled(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    plan = duplicate_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan
    assert filter_bits(10**12) == 2**28 and filter_bits(0) == 2**22
    assert duplicate_groups(docs).where("group_size = 1 and kept").count() == 2000


@pytest.mark.parametrize("columns", [("id", "body"), ("a.b", "the text")])
def test_other_column_names(spark, columns):
    doc_id, text = columns
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b")], f"`{doc_id}` long, `{text}` string")
    assert {r["keep_id"] for r in duplicate_groups(docs, doc_id, text).collect()} == {1}
    assert drop_duplicates(docs, doc_id, text).columns == list(columns)
    assert {r["component_id"] for r in jaccard_components(docs, doc_id, text).collect()} == {1}
