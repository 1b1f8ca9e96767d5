"""The corpus pipeline: stages over documents, each a corpus operator with its decisions applied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm.mixing import mix_sources, repeated
from stayline.llm.ngrams import similar_documents
from stayline.llm.quality import good_documents, train
from stayline.llm.sharding import assign_shards
from stayline.llm.templates import contaminated_documents
from stayline.session import checkpointed, scratch_tables

SHARD_BYTES = 1 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return good_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are 0.8 alike, the one with the smallest id stays.

    A document is an id with a text: of two texts under one id, only the one that is like a
    smaller id's text goes. Of rows equal in id and text the smallest by their other columns
    stays. Rows without an id, and null and empty texts, link with nothing. An empty table
    stays empty.
    """
    key = F.xxhash64("text").alias("__key")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    # only what goes and what is repeated outlives the join
    with scratch_tables(spark) as keep:
        document = [F.col("doc_id").cast("long").alias("__id"), key]
        copies = checkpointed(docs.groupBy(*document).agg((F.count(F.lit(1)) > 1).alias("many")))
        # an id's further texts get numbers of their own, above all ids
        several = copies.where("__id IS NOT NULL").groupBy("__id").agg(F.min("__key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        further = checkpointed(copies.join(several, "__id").where("__key <> first").select("__id", "__key"))
        above = (copies.agg(F.max("__id")).first()[0] or 0) + 1
        further = checkpointed(further.withColumn("number", F.monotonically_increasing_id() + above))
        if further.isEmpty():
            joined = similar_documents(docs, size=5, percent=80)
            gone = joined.where("component_id < doc_id").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
        else:
            numbered = docs.join(further, same, "left").select(F.coalesce("number", "doc_id").alias("doc_id"), "text")
            joined = similar_documents(numbered, size=5, percent=80).where("doc_id IS NOT NULL").distinct()
            known = joined.join(further.select(F.col("number").alias("doc_id"), "__id"), "doc_id", "left")
            known = checkpointed(known.select("component_id", F.coalesce("__id", "doc_id").alias("__id"), F.col("text_key").alias("__key")))
            least = known.groupBy("component_id").agg(F.min(F.struct("__id", "__key")).alias("least"))
            gone = known.join(least, "component_id").where(F.struct("__id", "__key") != F.col("least")).select("__id", "__key")
        gone = keep(gone.distinct())
        repeated_rows = keep(copies.where("many").join(gone, ["__id", "__key"], "left_anti").select("__id", "__key"))
    single = docs.join(gone.unionByName(repeated_rows), same, "left_anti")
    repeats = docs.join(repeated_rows, same)
    first = repeats.groupBy("__id", "__key").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return single.unionByName(first.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, its values changed or not, go."""
    found = contaminated_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    found = checkpointed(found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(found, same, "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in the proportion 1, 2, 3, repeating: documents are left out or repeated."""
    return repeated(docs, mix_sources(docs, weights=(1, 2, 3), most=3))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard of at most a MB of text."""
    return assign_shards(docs, byte_limit=SHARD_BYTES)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("shards", shards),
]
# the classifier is trained, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents in turn; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
