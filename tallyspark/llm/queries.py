"""The queries op<N>_<name> over the driver tables, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, linededup, lm, media, mixing, neardup, negatives, packing, pii, repair, tokenfile, toxicity, warc
from .common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.trained(docs.filter(crc_mod("doc_id", 10) != 0))
    found = lm.scored(docs, model, ((crc_mod("doc_id", 10) == 0),))
    return found.select("doc_id", F.col("_x0").alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.trained(toxicity.training_rows(docs, labels.filter(crc_mod("doc_id", 5) != 0)))
    found = toxicity.scored(docs, machine)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read(*tokenfile.write(table(spark, sf_dir, "documents"), tokenizer()))


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = media.extracted(media.store(table(spark, sf_dir, "documents")))
    seconds = F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["end"] - s["start"])
    feature = F.format_string("%d segments, %.3f s, %s", F.size("spans"), seconds, "tensors_sha256")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).withColumn("prob", F.round("prob", 6))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.deduped(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n = [number(kind) for kind in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *n, F.sha2(said(base), 256).alias("base_sha256"), said("spans").alias("spans"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write(table(spark, sf_dir, "pages"))
    found = warc.read(folder, index, keep_payload=False)
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repaired_conversations(conversations, repair.damaged(conversations))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer())


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(negatives.relabelled(table(spark, sf_dir, "embeddings")))


QUERIES = {f.__name__: f for f in (op1_pii, op2_warc, op3_lm_scores, op4_toxicity, op5_decontamination, op6_token_file, op7_audio_features, op8_mixing, op9_line_dedup, op10_near_duplicates, op11_conversation_repair, op12_packing, op13_hard_negatives)}
ORACLES = {"op2_warc": warc.sql(), "op5_decontamination": decontam.sql(), "op8_mixing": mixing.sql(), "op9_line_dedup": linededup.sql(), "op11_conversation_repair": repair.sql(), "op13_hard_negatives": negatives.sql()}
