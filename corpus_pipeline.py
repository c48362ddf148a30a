"""A training corpus from raw documents, in stages: each reads all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import mixing, near_dedup, packing, pii, toxicity
from quern.llm.common import Scratch, load

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, trained on the labelled ones, doesn't judge toxic."""
    machine = toxicity.train(docs, load(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).filter("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id. Rows without a doc_id stay; so do rows that share one but not their words."""
    kept = near_dedup.near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id")
    known = docs.filter("doc_id is not null")
    once = known.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    known = known.join(kept.distinct(), "doc_id", "left_semi").select(*docs.columns)
    if not once:  # repeated rows are a group too
        words = F.md5(F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower()), r"[\x20\x09-\x0D]+", " ")))
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        known = known.select("doc_id", words.alias("words"), row.alias("row")).groupBy("doc_id", "words").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return known.unionByName(docs.filter("doc_id is null"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind, n_chars counted anew."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Kernel machines, a trained field, drawn copies and a tokenizer are not SQL: tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        del before
    return docs
