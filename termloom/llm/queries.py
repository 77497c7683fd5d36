"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, counts, exact, graph_ann, hosts, langid, merkle, mix, records, runs, shard, simhash, substrings
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_components(table(spark, folder, "documents")).drop("text_hash")


def op2_histogram_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard.shard_table(table(spark, folder, "documents"))


def op3_graph_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return graph_ann.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN).drop("ids")


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify_languages(table(spark, folder, "documents"))


def op7_token_records(spark: SparkSession, folder: str) -> DataFrame:
    return records.record_table(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    labels = table(spark, folder, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    good = labels.select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")
    )
    return hosts.judge_urls(pages, good).select("page_id", "host", "path", "rule", "verdict")


def op9_fair_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mix_plan(table(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    low = F.translate("text", hosts.UPPER, hosts.LOWER)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = {"text": F.when(changed, low).otherwise(F.col("text"))}
    return merkle.merkle_manifest(table(spark, folder, "documents"), found=found).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", "verified",
    )


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = runs.with_planted_runs(table(spark, folder, "documents").select("doc_id", "text"))
    found = runs.periodic_runs(docs).withColumn("best", runs.strongest(F.col("runs")))
    lines = F.concat(runs.runs_text(F.col("runs")), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(F.expr("best.length * 1000 div best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_histogram_shards": op2_histogram_shards,
    "op3_graph_neighbors": op3_graph_neighbors,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_token_records": op7_token_records,
    "op8_url_reputation": op8_url_reputation,
    "op9_fair_mix": op9_fair_mix,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_substring_dedup": op13_substring_dedup,
}

SQL = {
    "op5_exact_dedup": exact.EXACT_SQL,
    "op8_url_reputation": hosts.HOSTS_SQL,
    "op9_fair_mix": mix.MIX_SQL,
    "op11_merkle_manifest": merkle.MERKLE_SQL,
}
