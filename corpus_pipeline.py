"""A corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the
last return the columns of ``documents``; the last returns packed pieces. Stages are written as
Parquet and read again, so each starts from a table without lineage.

A row is told apart by its id and its text. Rows equal in both are one document to the
near-duplicate stage; before it they are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odflux.llm import mixing, packing, quality_rules, simhash, suffix_dedup
from odflux.llm.common import materialize, table


def _carried(docs: DataFrame, *names: str) -> DataFrame:
    """The whole row as one column, next to the named ones; other columns cannot clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *names)


def _digest(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outlier of their language and source."""
    keyed = docs.select("doc_id", _digest("text").alias("digest"), "text", "lang", "source")
    counted = quality_rules.text_counts(keyed).select("doc_id", "digest", "lang", "source", "counts")
    counted = materialize(counted, "counts")
    judged = quality_rules.judge(counted, quality_rules.fit(counted))
    out = judged.where(~F.col("quality.kept")).select("doc_id", "digest").distinct()
    rows = _carried(docs, "doc_id", "text").select("row", "doc_id", _digest("text").alias("digest"))
    same = rows["doc_id"].eqNullSafe(out["doc_id"]) & (rows["digest"] == out["digest"])
    return rows.join(out, same, "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose SimHash fingerprints link: the smallest id.

    Three-word shingles and at most two differing bits, as in the operator's own query. Texts
    without words have one fingerprint and are one group. Rows equal in id and text stay once."""
    stay = simhash.keepers(simhash.simhash_groups(docs))
    keyed = _carried(docs, "doc_id", "text").select("row", "doc_id", _digest("text").alias("digest"))
    same = keyed["doc_id"].eqNullSafe(stay["doc_id"]) & (keyed["digest"] == stay["digest"])
    found = keyed.join(stay, same, "left_semi")
    once = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(F.lit(1)))
    return found.withColumn("once", once).where("once = 1").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; n_chars follows."""
    others = tuple(c for c in docs.columns if c != "text")
    left = suffix_dedup.remove_repeats(docs, keep=others)
    columns = {c: F.col(f"pass_{k}") for k, c in enumerate(others)}
    columns["text"] = F.col("kept_text")
    if "n_chars" in columns:
        columns["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return left.select(*[columns[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), _digest("text"))
    keyed = _carried(docs, "doc_id", "text", "source").select("row", key.alias("key"), "text", "source")
    copies = mixing.take(keyed, key="key").groupBy("key").agg(F.sum("copies").cast("int").alias("copies"))
    once = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))
    rows = keyed.select("row", "key").join(copies, "key").withColumn("once", once).where("once = 1 and copies > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's ids lies in sequences of 2048."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: Robust estimates, fingerprints and sampling have no SQL form; tests/llm holds each stage
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
