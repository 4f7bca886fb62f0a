"""Queries over the corpus operators, with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.llm import knn, langid, mixing, packing, pfor, pii, quality, simhash, tokencount, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


def pseudonym_key(spark: SparkSession) -> str:
    """The key that the session sets; where it sets none, one for demonstrations, which keeps nothing secret."""
    return spark.conf.get("spark.quillon.pseudonyms.key", None) or "demonstration"


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(_docs(spark, sf_dir).select("doc_id", "text"), pseudonym_key(spark), count_col="n_replaced")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), word_bpe())


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_docs(spark, sf_dir), _pieces())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.round_trip(_docs(spark, sf_dir), word_bpe())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_docs(spark, sf_dir)).drop("n_lines", "failed_rules")


def toxicity_training() -> Column:
    """Labels to learn from, by column doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.lit(True))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(toxicity_training()))
    rows = toxicity.scored(docs, model, [F.col("doc_id"), (~toxicity_training()).alias("held_out")])
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_simhash, op2_voronoi_knn, op3_language, op4_pseudonyms, op5_packing, op6_token_counts, op7_mixing, op8_token_ids, op9_quality, op10_toxicity]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_voronoi_knn": knn.oracle(100), "op7_mixing": mixing.oracle(), "op9_quality": quality.oracle()}
