"""Registered queries: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scatterwave.llm import decontaminate, exact_dedup, language, licences, line_dedup, packing, quality, secrets, simhash, token_records


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.digest(table(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark, sf_dir):
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op5_licence_scan(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return language.digest(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_records(spark, sf_dir):
    return token_records.digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_simhash_near_dedup(spark, sf_dir):
    return simhash.digest(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"), words=secrets.vocabulary_words(tokenizer_path()))


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_exact_dedup, op3_quality, op4_line_dedup, op5_licence_scan, op6_language_id, op7_decontaminate, op8_token_records, op9_simhash_near_dedup, op10_secret_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op4_line_dedup": line_dedup.ORACLE_SQL}
