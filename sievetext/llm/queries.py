"""Registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame`` over
whole tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import (chat, collocations, decontaminate, langid, matrices, merkle, ngrams, packing, pii,
               quality, secrets, simhash, toxicity)
from .common import table


def op1_chat_format(spark, sf_dir):
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


def op2_pii(spark, sf_dir):
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    return langid.language_digest(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality.quality_digest(table(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    return simhash.near_duplicate_digest(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.contamination_digest(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secrets(spark, sf_dir):
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_matrices(spark, sf_dir):
    return matrices.matrix_digest(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_collocations(spark, sf_dir):
    return collocations.collocation_digest(table(spark, sf_dir, "documents"))


def op12_merkle(spark, sf_dir):
    return merkle.manifest_digest(table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark, sf_dir):
    return ngrams.score_digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_chat_format, op2_pii, op3_language_id, op4_quality_rules, op5_simhash, op6_decontaminate,
    op7_secrets, op8_toxicity, op9_token_matrices, op10_packing, op11_collocations,
    op12_merkle, op13_lm_scoring)}

ORACLES: dict[str, str] = {
    "op1_chat_format": chat.ORACLE_SQL,
    "op4_quality_rules": quality.ORACLE_SQL,
    "op6_decontaminate": decontaminate.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op12_merkle": merkle.ORACLE_SQL,
    "op13_lm_scoring": ngrams.ORACLE_SQL,
}
