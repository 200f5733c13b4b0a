"""The pipeline on the smallest tables, stage by stage."""

import corpus_pipeline
from pyspark.sql import functions as F

from keyspan.llm.bitmaps import without_ids
from keyspan.llm.bpe import coder
from keyspan.llm.decontaminate import words_of
from keyspan.llm.quality import score_quality, train_quality
from tests.llm.fixtures import no_documents, odd_documents, prose
from tests.llm.test_pairs import brute_components, normal
from tests.llm.test_texts import VOCABULARY, brute_matches


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_every_stage(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    quality, dedup, near, clean, coding = (stage for _, stage in corpus_pipeline.STAGES)

    kept = quality(spark, docs, small_dir).cache()
    assert kept.columns == docs.columns
    good = score_quality(docs, train_quality(docs, labels)).where("predicted = 1")
    assert set(rows_of(kept)) == {r["doc_id"] for r in good.collect()}

    once, before = dedup(spark, kept, small_dir).cache(), rows_of(kept)
    least = {}
    for i, text in before.items():
        least[normal(text)] = min(i, least.get(normal(text), i))
    assert once.columns == docs.columns and set(rows_of(once)) == set(least.values())

    apart, before = near(spark, once, small_dir).cache(), rows_of(once)
    groups = brute_components(sorted(before.items()))
    assert apart.columns == docs.columns and set(rows_of(apart)) == {i for i, _, c in groups if i == c}

    fresh, before = clean(spark, apart, small_dir).cache(), rows_of(apart)
    items = [(str(r["item_id"]), words_of(r["text"])) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    hits = {i: len(brute_matches(items, words_of(t))[0]) for i, t in before.items()}
    assert fresh.columns == docs.columns and any(hits.values())
    assert set(rows_of(fresh)) == {i for i, n in hits.items() if not n or 20 * n < len(words_of(before[i]))}

    coded = coding(spark, fresh, small_dir).collect()
    tokenizer = coder(VOCABULARY).tokenizer
    assert {r["doc_id"]: r["ids"] for r in coded} == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in rows_of(fresh).items()}
    assert {(r["doc_id"], r["n_tokens"]) for r in coded} == {(r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, small_dir).collect()}


def test_stages_on_odd_and_no_documents(spark, small_dir):
    for docs in (odd_documents(spark), no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, small_dir).columns == docs.columns
            assert stage(spark, docs, small_dir).count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small_dir).count() == docs.count()


def test_dropping_ids(spark):
    docs = odd_documents(spark)
    gone = spark.createDataFrame([(12,), (1,), (None,), (999,)], "x long")
    left = without_ids(docs, "doc_id", gone)
    assert left.columns == docs.columns
    assert left.count() == docs.where(F.coalesce(~F.col("doc_id").isin(1, 12), F.lit(True))).count()


def test_rows_that_share_an_id_or_have_none_are_judged_one_by_one(spark, small_dir):
    _, _, near, clean, _ = (stage for _, stage in corpus_pipeline.STAGES)
    item = next(r["text"] for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect() if len(words_of(r["text"])) >= 13)
    rows = [(1, prose(800, 60)), (1, item), (None, item), (None, prose(801, 60)), (2, item), (3, prose(802, 60))]
    left = clean(spark, odd_documents(spark, rows), small_dir)
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == {rows[k] for k in (0, 3, 5)}

    copied = prose(803, 90)
    rows = [(1, copied), (5, copied.replace(copied.split()[40], "changed", 1)), (5, prose(804, 60)), (None, copied), (6, prose(805, 60))]
    docs = odd_documents(spark, rows)
    left = near(spark, docs, small_dir)
    assert left.columns == docs.columns and {(r["doc_id"], r["text"]) for r in left.collect()} == {rows[k] for k in (0, 2, 3, 4)}
