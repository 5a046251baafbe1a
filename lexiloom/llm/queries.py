"""Queries of the training-data operators over the whole tables, with their DuckDB oracles."""

from __future__ import annotations

from lexiloom.llm import alignment, decontaminate, host_rules, language_id, license_scan, lm_score, media, mixing, near_dedup, quality, secret_scan, suffix_dedup, upsert
from lexiloom.llm.common import table


def op1_decontaminate(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op4_license_scan(spark, sf_dir):
    return license_scan.digest(table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_lm_score(spark, sf_dir):
    return lm_score.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark, sf_dir):
    return language_id.digest(table(spark, sf_dir, "documents"))


def op8_media(spark, sf_dir):
    return media.digest(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark, sf_dir):
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark, sf_dir):
    return near_dedup.digest(table(spark, sf_dir, "documents"))


def op11_upsert(spark, sf_dir):
    return upsert.digest(table(spark, sf_dir, "clients"), table(spark, sf_dir, "client_changes"))


def op12_alignment(spark, sf_dir):
    return alignment.digest(table(spark, sf_dir, "documents"))


def op13_host_rules(spark, sf_dir):
    return host_rules.digest(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_decontaminate, op2_quality, op3_suffix_dedup, op4_license_scan, op5_mixing, op6_lm_score, op7_language_id, op8_media, op9_secret_scan,
    op10_near_dedup, op11_upsert, op12_alignment, op13_host_rules,
)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLE_SQL = {"op1_decontaminate": decontaminate.ORACLE, "op5_mixing": mixing.ORACLE, "op13_host_rules": host_rules.ORACLE}
