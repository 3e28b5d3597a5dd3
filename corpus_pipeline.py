"""A corpus from raw documents to shards: good texts, one of each group of near copies, no benchmark items, mixed, sharded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet before the next one
reads it. All but the last return the columns of ``docs``, whatever these are. Rows that share a doc_id are judged
one by one; rows without words or text are no copies of each other; of rows that repeat each other in all columns
one stays after near-dedup. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import hamming_minhash, histogram_sort, mixing, positional_index, rule_ensemble
from trackloom.llm.queries import MIX_EPOCHS, MIX_TOTAL, MIX_WEIGHTS
from trackloom.llm.shared import documents, row_hash, staged, without


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    return rule_ensemble.accepted(docs, documents(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: of those with the smallest doc_id, the one with the smallest hash."""
    rows = docs.select("doc_id", "text", row_hash(docs).alias("row"))
    found = staged(hamming_minhash.judged(rows).select("row", "label", "kept"), "near")
    first = found.where("kept and label is not null")
    several = first.groupBy("label").agg(F.min("row").alias("stays"), F.count("*").alias("n")).where("n > 1")
    shared = staged(first.join(several, "label").select("row", "stays"), "shared")  # rows of a component that share its smallest doc_id
    left = without(docs, found.where("not kept").select("row").unionByName(shared.where("row <> stays").select("row")))
    twins = shared.where("row = stays").groupBy("row").count().where("count > 1")
    if twins.isEmpty():
        return left
    return without(left, twins).unionByName(without(left, twins, gone=False).dropDuplicates())


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the contract allows."""
    rows = docs.select(row_hash(docs).alias("doc_id"), "text")
    found = positional_index.contaminated_documents(rows, documents(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated").select(F.col("doc_id").alias("row")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition that the mix takes of a document."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("document"))
    taken = mixing.mixed(rows, MIX_WEIGHTS, MIX_TOTAL, MIX_EPOCHS)
    return taken.select("document", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("document.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """24 shards of nearly equal bytes."""
    return histogram_sort.shard_documents(docs, 24)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The classifier's learnt rules can't be said in SQL; tests hold near-dedup and decontamination against brute-force
#: versions, the quality stage against the rows that its query accepts, and the mix and the shards against their laws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
