"""The operators of this subpackage as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import op1

    return op1(table(spark, sf_dir, "pages"))


def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import op2

    return op2(table(spark, sf_dir, "documents"))


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import op3

    return op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import op4

    return op4(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import op5

    return op5(table(spark, sf_dir, "documents"))


def op6_random_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import op6

    return op6(table(spark, sf_dir, "embeddings"))


def op7_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import op7

    return op7(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import op8

    return op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import op9

    return op9(table(spark, sf_dir, "conversations"))


def op10_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import op10

    return op10(table(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import op11

    return op11(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import op12

    return op12(table(spark, sf_dir, "embeddings"))


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixture import op13

    return op13(table(spark, sf_dir, "documents"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import chat, decontaminate, divergence, neardup, warc

    return {"op4_minhash_near_dedup": neardup.ORACLE_SQL, "op8_benchmark_decontamination": decontaminate.ORACLE_SQL, "op9_chat_reply_trees": chat.ORACLE_SQL, "op10_warc_index_first": warc.ORACLE_SQL, "op11_source_divergence": divergence.ORACLE_SQL}
