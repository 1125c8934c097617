"""The ten operators over their whole tables with production parameters, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import chosen_path, langid_ecoc, license_rules, line_templates, lz_fingerprint, packing, phrase_index, quality_knn, url_rules, warc_segments
from palisade.llm.common import table


def _crc_mod(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_knn.fit(docs, labels.filter(_crc_mod(3) != 1))
    return quality_knn.classify(docs, model).select("doc_id", (_crc_mod(3) == 1).alias("held_out"), "score", "predicted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid_ecoc.fit(docs.filter(_crc_mod(5) != 0))
    return langid_ecoc.predict(docs, model).select("doc_id", (_crc_mod(5) == 0).alias("held_out"), "lang_pred", "score", "margin", "ambiguous")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "licenses", "n_sentences", "rule_hits")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, url_rules.rule_table(spark, url_rules.RULES)).select("page_id", "host", "path", "rule", "verdict")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_segments.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_language_id, op3_ngram_jaccard_join, op4_packing, op5_line_dedup, op6_license_scan, op7_url_filter, op8_decontamination, op9_lz_fingerprint, op10_warc)}

ORACLES = {
    "op3_ngram_jaccard_join": chosen_path.ORACLE,
    "op5_line_dedup": line_templates.ORACLE,
    "op6_license_scan": license_rules.oracle(),
    "op7_url_filter": url_rules.ORACLE,
    "op8_decontamination": phrase_index.ORACLE,
    "op10_warc": warc_segments.ORACLE,
}
