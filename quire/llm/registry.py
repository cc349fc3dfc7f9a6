"""The queries over this subpackage's operators, and their SQL."""

from __future__ import annotations

from quire.llm import ann, content_sort, divergence, langid, media, mixing, ngram_join, pieces, repair, secrets, sharding, tokens, toxicity
from quire.session import table


def op1_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return tokens.op2(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    return langid.op3(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op4_media_columns(spark, sf_dir):
    return media.op4(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scans(spark, sf_dir):
    return secrets.op6(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark, sf_dir):
    return ann.op7(table(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark, sf_dir):
    return pieces.op8(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.op9(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.op10(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark, sf_dir):
    return divergence.op11(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark, sf_dir):
    return content_sort.op12(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return repair.op13(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_ngram_jaccard_join": ngram_join.SQL,
        "op11_source_divergence": divergence.SQL,
        "op12_exact_dedup": content_sort.SQL,
        "op13_conversation_repair": repair.SQL,
    }
