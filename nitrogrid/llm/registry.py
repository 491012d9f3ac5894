"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from nitrogrid.llm import (
    decontamination, exact_dedup, language_id, license_scan, near_dedup, packing, piece_spans, substring_dedup, suffix_dedup,
    token_counts, toxicity, vector_codes, word_runs,
)
from nitrogrid.llm.common import documents


def op1_set_similarity_license_scan(spark, sf_dir):
    return license_scan.license_blocks(documents(spark, sf_dir))


def op2_recompression_substring_dedup(spark, sf_dir):
    return substring_dedup.without_repeats(documents(spark, sf_dir))


def op3_probminhash_near_dedup(spark, sf_dir):
    return near_dedup.near_classes(documents(spark, sf_dir))


def op4_ordinal_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return toxicity.graded(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_bloom_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


def op6_latent_decontamination(spark, sf_dir):
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.packed(documents(spark, sf_dir)).drop("ids")


def op8_rank_synchronous_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir))


def op9_column_wise_suffix_dedup(spark, sf_dir):
    return suffix_dedup.without_repeats(documents(spark, sf_dir))


def op10_crf_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return language_id.predicted(docs, language_id.fit(docs))


def op11_walsh_hadamard_vector_codes(spark, sf_dir):
    return vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_offset_preserving_pieces(spark, sf_dir):
    return piece_spans.digests(documents(spark, sf_dir))


def op13_suffix_automaton_runs(spark, sf_dir):
    return word_runs.run_digests(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_set_similarity_license_scan, op2_recompression_substring_dedup, op3_probminhash_near_dedup, op4_ordinal_toxicity, op5_bloom_exact_dedup,
    op6_latent_decontamination, op7_best_fit_packing,
    op8_rank_synchronous_token_counts, op9_column_wise_suffix_dedup, op10_crf_language_id,
    op11_walsh_hadamard_vector_codes, op12_offset_preserving_pieces, op13_suffix_automaton_runs,
)}

ORACLE = {
    "op1_set_similarity_license_scan": license_scan.oracle_sql(),
    "op5_bloom_exact_dedup": r"""
        WITH h AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS sha
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY sha) AS keep_id,
               count(*) OVER (PARTITION BY sha) AS group_size,
               row_number() OVER (PARTITION BY sha ORDER BY doc_id) = 1 AS kept,
               sha AS text_sha256
        FROM h
    """,
    "op11_walsh_hadamard_vector_codes": vector_codes.oracle_sql(),
}
