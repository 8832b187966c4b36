"""The subpackage's queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fill_middle, html_extract, line_frequency, lm_score, mixing, near_dup, pii, repair, sharding, sql, token_counts, url_rules
from .common import read


def op1_template_deduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.quality(read(spark, sf_dir, "documents"))


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"))


def op4_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op5_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op6_soft_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_count_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), token_counts.load_vocabulary())


def op8_fast_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), near_dup.CONTRACT)


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"))


def op10_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _equals(k: int) -> Callable[[Column], Column]:
    return lambda x: x == k


def op11_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter(F.transform("base", lambda e: e.kind), _equals(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op12_distinct_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_cost_to_go_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_template_deduction,
        op2_line_frequency,
        op3_virtual_slots,
        op4_snapshot_collapse,
        op5_association_rules,
        op6_soft_membership,
        op7_count_viterbi,
        op8_fast_similarity,
        op9_deleted_interpolation,
        op10_prefix_filter,
        op11_weak_supervision,
        op12_distinct_text_index,
        op13_cost_to_go_repair,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
