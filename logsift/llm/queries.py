"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.llm import (
    chat, covertree, decontaminate, divergence, fim, langid, mixing, neardup, packing, quality, sharding, tokenizing, toxicity)
from logsift.llm.common import crc_mod, stage, table


def op1_packing(spark, sf_dir):
    return packing.piece_digest(packing.pack(table(spark, sf_dir, "documents")))


def op2_token_counts(spark, sf_dir):
    return tokenizing.count_tokens(table(spark, sf_dir, "documents"))


def op3_hilbert_shards(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents")).drop("curve")


def op4_cover_tree(spark, sf_dir):
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark, sf_dir):
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def training_labels(spark, sf_dir, target, mod, held):
    """(doc_id, y) of the rows that may be learned from: the fold ``held`` is left out."""
    return (table(spark, sf_dir, "labels").where(crc_mod("doc_id", mod) != held)
            .select("doc_id", F.col(target).alias("y")))


def _predicted(scores, mod, held, threshold):
    return scores.select("doc_id", (crc_mod("doc_id", mod) == held).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality(spark, sf_dir):
    stats = stage(quality.features(table(spark, sf_dir, "documents")), "quality-stats")
    model = quality.fit(stats, training_labels(spark, sf_dir, "quality", 3, 1))
    return _predicted(quality.score(stats, model), 3, 1, 0.5)


def op8_minhash(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_chat(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, training_labels(spark, sf_dir, "toxic", 4, 2))
    return _predicted(toxicity.score(docs, model), 4, 2, 0.3)


def op11_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_fim(spark, sf_dir):
    return fim.digest(fim.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_token_counts": op2_token_counts,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_cover_tree": op4_cover_tree,
    "op5_decontamination": op5_decontamination,
    "op6_language": op6_language,
    "op7_quality": op7_quality,
    "op8_minhash": op8_minhash,
    "op9_chat": op9_chat,
    "op10_toxicity": op10_toxicity,
    "op11_mixing": op11_mixing,
    "op12_divergence": op12_divergence,
    "op13_fim": op13_fim,
}

ORACLE_SQL = {"op4_cover_tree": covertree.SQL, "op8_minhash": neardup.SQL, "op9_chat": chat.SQL, "op11_mixing": mixing.SQL,
              "op12_divergence": divergence.SQL, "op13_fim": fim.SQL}
