"""A corpus pipeline out of the text operators: each stage is written as Parquet and read again by the next.

The pipeline works on the columns of ``documents`` (``COLUMNS``); any others are dropped, so none can clash with what the
operators add. All stages: null and empty texts count as without words, very long texts are handled whole, repeated rows are
each judged, rows without doc_id are kept unless their own text fails, and an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import decontaminate, near_copies, pieces, private_data, quality
from framewright.llm.queries import SURROGATE_KEY
from framewright.llm.store import new_path, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that failed and n_chars brought in line. Texts of fewer
    than 50 words go, null and empty ones among them. The results are stored, so that the filter reads them."""
    judged = quality.quality_rules(docs.select(*COLUMNS))
    changed = F.col("clean_text") != F.col("text")
    n_chars = F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    cleaned = judged.withColumn("n_chars", n_chars).withColumn("text", F.col("clean_text")).select(*COLUMNS, "kept")
    return stored(cleaned).filter("kept").select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the rows of the smallest doc_id; rows without a doc_id, and
    texts without words, stay. Rows of one doc_id are judged by their own texts."""
    return near_copies.without_near_copies(docs.select(*COLUMNS), k=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item, or a whole shorter item; null texts have none and stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs.select(*COLUMNS), items)


def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, private data replaced by surrogates and n_chars brought in line; null texts stay null."""
    replaced = private_data.replace_private_data(docs.select(*COLUMNS), SURROGATE_KEY)
    n_chars = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", n_chars).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids (an end id last), and whether decoding gives the text again; a null text has the end id
    alone, and its decoding is compared with the empty text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.decode(pieces.encode(docs.select(*COLUMNS), model), model)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("private_data", private_data_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL cannot express the near-copy operator's hashes, the surrogates or the encoding; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = new_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
