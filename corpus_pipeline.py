"""The corpus pipeline: documents to packed training sequences, a stage at a time.

Every stage works on all rows that its predecessor kept. All but the last return the columns of documents.

Defined results: a null text has no words, so the quality rules reject it; rows with a null id are never copies of others
and stay; of linked rows one stays, while rows that are not linked stay also where they share an id; columns beyond those of documents are handed on by the filtering stages whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

CAPACITY = 1024


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep (operator 4)."""
    from strandline.llm.quality_rules import judge

    # One struct holds the columns of documents, so that none clashes with the measures.
    held = docs.withColumn("_row", F.struct(*docs.columns))
    return judge(held, keep=("_row",)).where("kept").select("_row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents (operator 10): the first row of the smallest id.

    Texts that do not link all stay, also where they share an id. So that they are told apart, all rows of an id but the first, by
    text and then by the other columns, get numbers above all ids for the join, and come after the ids in a group.
    """
    from strandline.llm._spark import stored
    from strandline.llm.ngram_join import classify

    known, null = docs.where(F.col("doc_id").isNotNull()), docs.where(F.col("doc_id").isNull())
    several = stored(known.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_times")).where("_times > 1").select("_id"), "repeated_ids")
    held = known.select(F.col("doc_id").alias("_id"), F.struct(*docs.columns).alias("_row"))

    def firsts(nodes: DataFrame) -> DataFrame:
        return classify(nodes).where("doc_id = component_id").select(F.col("doc_id").alias("_id"))

    if several.isEmpty():
        return held.join(firsts(docs), "_id", "left_semi").select("_row.*").unionByName(null)
    # Dealt by ranges of all columns, so rows of one id may lie in many tasks; numbers rise with the order.
    order = [F.col("_id"), *(F.col("_row")[f.name] for f in sorted(docs.schema.fields, key=lambda f: f.name != "text") if not isinstance(f.dataType, (MapType, VariantType)))]
    again = stored(held.join(several, "_id", "left_semi").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "repeated_rows")
    top = known.agg(F.max("doc_id")).first()[0] + 1
    first = again.groupBy("_id").agg(F.min("_m").alias("_first"))
    again = again.join(first, "_id").select(F.when(F.col("_m") == F.col("_first"), F.col("_id")).otherwise(F.col("_m") + top).alias("_id"), "_row")
    every = held.join(several, "_id", "left_anti").unionByName(again)
    stay = firsts(every.select(F.col("_id").alias("doc_id"), F.col("_row.text").alias("text")))
    return every.join(stay, "_id", "left_semi").select("_row.*").unionByName(null)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of 50 words that an earlier one has; a document of which nothing is left goes (operator 5)."""
    from strandline.llm.substring_dedup import remove_repeats

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = docs.select("doc_id", "text", F.struct(*others).alias("_row"))
    clean = remove_repeats(held).where("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    new = {c: F.col("_row")[c] for c in others} | {"doc_id": F.col("doc_id"), "text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in others:
        new["n_chars"] = F.when(changed, F.length("kept")).otherwise(new["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return clean.select(*[new[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and their places in sequences of CAPACITY (operator 6)."""
    from strandline.llm.packing import pack_documents

    return pack_documents(docs, CAPACITY)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: Tokenising can't be said in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of documents: doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset."""
    from strandline.llm._spark import drop_stored, scope, stored

    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scope(spark):  # what a stage stores for itself goes when its result is stored
            docs = stored(stage(spark, before, sf_dir), name, keep=True)
        if hasattr(before, "_stored_path"):
            drop_stored(before)
        before = docs
    return docs
