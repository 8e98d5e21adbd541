"""The corpus operators as named queries over the sample tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.llm import (
    decontamination,
    license_scans,
    minhash,
    paragraph_dedup,
    pca_clustering,
    quality_classifier,
    quality_rules,
    secret_scans,
    sentence_pieces,
    simhash,
    suffix_dedup,
    vector_codes,
    warc,
)
from modelwatch.llm.common import stored, table
from modelwatch.llm.sql import SQL  # noqa: F401  (the twins of these queries)
from modelwatch.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_secret_scans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secret_scans.find_secrets(
        docs, owner=F.col("source"), repository=F.concat_ws("/", F.col("source"), F.col("lang"))
    )
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_shared"
    )


@query
def op7_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("score", 6).alias("score"),
    )


@query
def op8_sentence_pieces(spark, sf_dir):
    encoded = sentence_pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encoded.select("doc_id", "n_pieces", "ids_sha256", "lossless", "piece_ids")


@query
def op9_license_scans(spark, sf_dir):
    scanned = license_scans.scan_licenses(table(spark, sf_dir, "documents"))
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"),
        F.size("notices").cast("long").alias("n_notices"),
    )


@query
def op3_decontamination(spark, sf_dir):
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op5_warc(spark, sf_dir):
    path = scratch_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    resolved = warc.resolve(stored(warc.read_archives(spark, path, payloads=False), "warc-records"))
    as_id = lambda name: F.col(name).cast("long").alias(name)
    return resolved.select(as_id("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to"))


@query
def op2_minhash_near_dedup(spark, sf_dir):
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op10_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op4_quality_classifier(spark, sf_dir):
    scored = quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.round("p_bad", 6).alias("p_bad"), F.round("p_toxic", 6).alias("p_toxic"), "kept")


@query
def op1_substring_dedup(spark, sf_dir):
    found = paragraph_dedup.repeated_paragraphs(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_paragraphs", "n_removed", "n_words_removed", "copies_of")


@query
def op11_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id", "kept")


@query
def op12_centroid_clustering(spark, sf_dir):
    found = pca_clustering.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query
def op13_vector_codes(spark, sf_dir):
    found = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
