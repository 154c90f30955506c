"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import chosen_path, decontaminate, divergence, idstore, langid, licenses, oracles, quality, repeats, sitetree, toxicity, vectorcodes, warc, wordbpe
from scorelake.llm.common import table, tokenizer
from scorelake.session import scratch_path, tune


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: ids of a run of 80 lie below one module, and one in 20 is its LICENSE."""
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    module = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("m"), F.floor(n / 80)))
    path = F.when(n % 20 == 3, F.concat(module, F.when(n % 40 == 3, F.lit("/LICENSE-")).otherwise(F.lit("/sub/LICENSE-")), n)).otherwise(
        F.concat(module, F.when(n % 3 == 0, F.lit("/sub/deep/")).otherwise(F.lit("/src/")), n, F.lit(".txt")))
    return licenses.scan(docs.select(n.alias("file_id"), path.alias("path"), "text")).withColumnRenamed("file_id", "doc_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.measure_repeats(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.code_rows(table(spark, sf_dir, "embeddings"))


def op12_token_id_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are written, and then found again by their keys and read from the files."""
    docs = table(spark, sf_dir, "documents")
    store = idstore.write(docs, tokenizer("word_bpe_49k.json"), scratch_path(spark, "ids"), end=2)
    return store.checks(docs)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


_QUERIES = [op1_quality_rules, op2_warc_derivatives, op3_license_scan, op4_language_id, op5_html_extraction, op6_toxicity, op7_suffix_array_dedup,
            op8_minhash_near_dedup, op9_bpe, op10_benchmark_decontamination,
            op11_vector_codes, op12_token_id_index, op13_source_divergence]
_ORACLES = {"op1_quality_rules": oracles.QUALITY, "op8_minhash_near_dedup": oracles.NEAR_DUPLICATES, "op10_benchmark_decontamination": oracles.LEAKS,
            "op11_vector_codes": oracles.vector_codes(), "op13_source_divergence": oracles.DIVERGENCE}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def tuned(fn):
        return lambda spark, sf_dir: fn(tune(spark), sf_dir)
    return {fn.__name__: tuned(fn) for fn in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
