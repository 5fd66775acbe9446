"""The registered queries of the numbered operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import bpe_codec, decontaminate, embedding_links, language_id, line_dedup, main_text, minhash_dedup, oracles, ppm_scores, quality, ranked_search, spelling, token_counts, toxicity

#: The vocabulary of operators 7 and 9.
VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, folder, "documents"))


def vocabulary() -> bytes:
    """The bytes of the vocabulary file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(VOCABULARY), "rb") as file:
        return file.read()


def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.main_texts(_table(spark, folder, "pages"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.keep_lines(_table(spark, folder, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), digest.alias("text_sha256"))


def op4_embedding_links(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_links.near_links(_table(spark, folder, "embeddings"))


def op5_ppm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ppm_scores.scores(_table(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, _table(spark, folder, "labels")))


def op7_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_codec.round_trip(_table(spark, folder, "documents"), vocabulary())


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.quality(docs, quality.train(docs, _table(spark, folder, "labels")))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"), vocabulary())


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return language_id.languages(docs, language_id.train(docs))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_main_text": op2_main_text,
    "op3_line_dedup": op3_line_dedup,
    "op4_embedding_links": op4_embedding_links,
    "op5_ppm_scores": op5_ppm_scores,
    "op6_toxicity": op6_toxicity,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_decontaminate": op10_decontaminate,
    "op11_language_id": op11_language_id,
    "op12_ranked_search": op12_ranked_search,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op1_minhash_dedup": oracles.MINHASH,
    "op4_embedding_links": oracles.EMBEDDINGS,
    "op10_decontaminate": oracles.DECONTAMINATE,
    "op12_ranked_search": oracles.SEARCH,
    "op13_spelling_variants": oracles.SPELLING,
}
