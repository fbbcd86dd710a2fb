"""The registered opN queries: the operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.ann_forest import nearest_neighbours
from wordloom.llm.common import read
from wordloom.llm.decontam import DECONTAMINATION_SQL, decontamination
from wordloom.llm.embed_dedup import embedding_components
from wordloom.llm.filter_audit import FILTER_AUDIT_SQL, filter_audit
from wordloom.llm.hard_negatives import HARD_NEGATIVES_SQL, hard_negatives
from wordloom.llm.line_dedup import fuzzy_lines
from wordloom.llm.mixing import mix_sources
from wordloom.llm.ngram_join import ngram_jaccard_components
from wordloom.llm.packing import pack
from wordloom.llm.quality import quality_scores
from wordloom.llm.sharding import assign_shards, sharding_sql
from wordloom.llm.url_filter import RULES, judge_urls, judge_urls_sql, rule_table
from wordloom.llm.warc import warc_round_trip


def op1_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read(spark, sf_dir, "documents"), shards=24)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(read(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op5_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where("vec_id % 20 = 0"), k=20)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark, sf_dir)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines(read(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), rule_table(spark, RULES))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_quality_bayes, op2_embedding_dedup, op3_hash_tree_shards, op4_ngram_jaccard, op5_ann_forest, op6_warc,
        op7_mixing, op8_fuzzy_lines, op9_url_rules, op10_harmonic_packing,
        op11_hard_negatives, op12_filter_audit, op13_decontamination)}


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
groups AS (SELECT html, max(page_id) AS first, count(*) AS n FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN groups ON p.html = groups.html"""


def oracle_sql() -> dict[str, str]:
    return {"op3_hash_tree_shards": sharding_sql(24), "op6_warc": WARC_SQL, "op9_url_rules": judge_urls_sql(),
            "op11_hard_negatives": HARD_NEGATIVES_SQL, "op12_filter_audit": FILTER_AUDIT_SQL,
            "op13_decontamination": DECONTAMINATION_SQL}
