"""The dealt operators over their whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm.bpe import encode
from keyspan.llm.decontaminate import find_matches, is_contaminated, n_hit
from keyspan.llm.exact_dedup import duplicate_groups
from keyspan.llm.fertility import quality_rules
from keyspan.llm.html_text import extract_text, train_tree
from keyspan.llm.jaccard import jaccard_components
from keyspan.llm.line_spread import remove_boilerplate
from keyspan.llm.quality import score_quality, train_quality
from keyspan.llm.span_dedup import remove_repeated_spans
from keyspan.llm.staging import ship_package
from keyspan.llm.token_alignment import score_alignment
from keyspan.llm.token_counts import count_tokens
from keyspan.llm.url_rules import judge_urls
from keyspan.llm.whitening import whiten

# Host, path, verdict: the rules of the contract.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, _table(spark, sf_dir, "labels")))


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(_table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return extract_text(pages, train_tree(pages))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = find_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    counted = matches.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit(F.col("spans")).alias("n_hit"), "items")
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return encode(_table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"), digests=True)


def op7_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return count_tokens(_table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(_table(spark, sf_dir, "documents"))


def op9_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(_table(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(_table(spark, sf_dir, "pages"), rules)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    import public_tokenizers

    paths = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    return score_alignment(_table(spark, sf_dir, "documents"), *paths)


def op13_fertility(spark: SparkSession, sf_dir: str, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    import public_tokenizers

    paths = byte_path or public_tokenizers.path("byte_bpe_50k.json"), piece_path or public_tokenizers.path("piece_bpe_32k.model")
    return quality_rules(_table(spark, sf_dir, "documents"), *paths)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_quality": op2_quality,
    "op3_line_spread": op3_line_spread,
    "op4_html_text": op4_html_text,
    "op5_decontamination": op5_decontamination,
    "op6_bpe": op6_bpe,
    "op7_token_counts": op7_token_counts,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_span_dedup": op9_span_dedup,
    "op10_url_rules": op10_url_rules,
    "op11_whitening": op11_whitening,
    "op12_alignment": op12_alignment,
    "op13_fertility": op13_fertility,
}

ORACLES: dict[str, str] = {
    "op3_line_spread": r"""
        WITH cut AS (
            SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
        ), each AS (
            SELECT doc_id, source, no, trim(regexp_replace(lines[no], '[\x20\x09-\x0D]+', ' ', 'g')) AS line
            FROM (SELECT doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS no FROM cut)
        ), boilerplate AS (
            SELECT line FROM each WHERE line != '' GROUP BY line HAVING count(DISTINCT source) + (count(*) > count(source))::INT >= 8
        ), sorted_out AS (
            SELECT doc_id, list(no) FILTER (line IN (FROM boilerplate)) AS removed FROM each GROUP BY doc_id
        )
        SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(removed), 0)::BIGINT AS n_removed,
               CASE WHEN removed IS NULL THEN text
                    ELSE coalesce(array_to_string([lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(removed, i)], chr(10)), '') END AS text
        FROM cut LEFT JOIN sorted_out USING (doc_id)
    """,
    "op5_decontamination": r"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), items AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM benchmark
        ), item_windows AS (
            SELECT DISTINCT item_id, size, array_to_string(words[i : i + size - 1], ' ') AS run
            FROM (SELECT item_id, words, least(13, len(words)) AS size, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i
                  FROM items WHERE len(words) > 0)
        ), starts AS (
            SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
            FROM docs, (SELECT DISTINCT size FROM item_windows) WHERE len(words) >= size
        ), found AS (
            SELECT doc_id, i, s.size, item_id
            FROM (SELECT doc_id, i, size, array_to_string(words[i : i + size - 1], ' ') AS run FROM starts) s
            JOIN item_windows w ON s.run = w.run AND s.size = w.size
        ), hits AS (
            SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM found) GROUP BY doc_id
        ), whose AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items,
                   sha256(array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',')) AS items_sha256
            FROM found GROUP BY doc_id
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN whose USING (doc_id)
    """,
    "op8_exact_dedup": r"""
        WITH hashed AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        ), sized AS (
            SELECT doc_id, text_sha256, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM hashed
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM sized
    """,
    "op10_url_rules": r"""
        WITH rules(rule_host, rule_path, rule_verdict) AS (
            VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                   ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
        ), parts AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages
        ), fitting AS (
            SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
            FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY page_id
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fitting USING (page_id)
    """,
}
