"""The registered queries of the text operators: production parameters, whole tables, whole results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, licenses, lm, main_text, near_copies, pieces, private_data, quality, repeats, toxicity, urls, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_copies.near_copy_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "n_shingles", "component_id")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality; background: all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.cross_entropy_difference(docs, _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urls.url_filter(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs).select("doc_id", *quality.RESULTS[:7])


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.decode(pieces.encode(docs, model).select("doc_id", "ids"), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.benchmark_hits(docs, _table(spark, sf_dir, "benchmark"))


def op10_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.replace_private_data(_table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = main_text.extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), name="text")
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit_whitening(vectors, most=4)
    each = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    shares = F.array(*(F.lit(float(x)) for x in (model.explained if model else []))).cast("array<double>")
    return each.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


#: Stands in for a secret that a deployment would pass; fixed here so that results are repeatable.
SURROGATE_KEY = "surrogate-key-1"

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_license_scans": op2_license_scans,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_private_data": op10_private_data,
    "op11_html_extraction": op11_html_extraction,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}
