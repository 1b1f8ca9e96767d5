"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm.embeddings import link_vectors
from stayline.llm.identifiers import KINDS, find_identifiers, span_list
from stayline.llm.licenses import scan_licenses
from stayline.llm.manifest import fold, merkle_manifest, proof_text
from stayline.llm.mixing import mix_sources
from stayline.llm.ngrams import similar_documents
from stayline.llm.packing import pack_documents
from stayline.llm.quality import score_documents, train
from stayline.llm.sharding import assign_shards
from stayline.llm.substrings import remove_repeated_windows
from stayline.llm.templates import contaminated_documents
from stayline.llm.urls import judge_urls
from stayline.llm.whitening import whiten

SHARD_BYTES = 1 << 20
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = assign_shards(table(spark, sf_dir, "documents"), byte_limit=SHARD_BYTES)
    return sharded.select("doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_docs")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "items", "reparameterised")


def op6_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = similar_documents(table(spark, sf_dir, "documents"), size=3, percent=90)
    return joined.select("doc_id", "n_shingles", "component_id")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_windows(table(spark, sf_dir, "documents"), window=50)
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_identifiers(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda span: span["kind"])
    others = [F.size("base") - F.size(F.array_remove(kinds, kind)) for kind in KINDS]
    counts = [n.cast("long").alias(f"n_{kind}") for n, kind in zip(others, KINDS, strict=True)]
    return found.select(
        "doc_id", *counts, F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans")
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels"), unwanted="toxic"))
    kept = (F.col("score") >= 0.5) & (F.coalesce("unwanted", F.lit(0.0)) < 0.5)
    return scored.select("doc_id", "by_text", "by_metadata", "score", F.col("unwanted").alias("toxic"), kept.alias("kept"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=32)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    manifest = merkle_manifest(docs, fields, "doc_id", "source", altered=[*fields[:-1], tampered])
    folded = fold(F.col("altered_leaf"), F.col("steps"))
    return manifest.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("steps")), 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_urls": op1_urls,
    "op2_embeddings": op2_embeddings,
    "op3_mixing": op3_mixing,
    "op4_sharding": op4_sharding,
    "op5_decontamination": op5_decontamination,
    "op6_ngrams": op6_ngrams,
    "op7_substrings": op7_substrings,
    "op8_pii": op8_pii,
    "op9_licenses": op9_licenses,
    "op10_quality": op10_quality,
    "op11_packing": op11_packing,
    "op12_whitening": op12_whitening,
    "op13_manifest": op13_manifest,
}
