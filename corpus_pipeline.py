"""A corpus pipeline of five stages over documents; each is written as Parquet and read back for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontam, langid, packing, pii, simhash
from barloom.llm.common import bound_batches, removed, staged, table

#: SQL cannot express compression or tokenizers; tests/llm compares the stages with brute force.
ORACLE_SQL = None

#: Of the pseudonyms, for demonstration; give your own and keep it.
KEY = "corpus-demonstration-key"


def held(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator needs beside the whole row, so that none of its results replaces a column of docs."""
    return docs.select(F.struct("*").alias("_row"), *[c for c in columns if c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: no letter, or no language clearly ahead of the others."""
    return langid.classify(held(docs, "doc_id", "text", "lang")).where(~F.col("rejected")).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group of near copies; documents without an id all stay.

    Near copies share 0.8 of their five-word shingles. Rows that repeat a kept doc_id are the same document and stay together.
    The joins of texts ask for a merge, so that a small corpus takes the plan of a large one, whose ids can't be broadcast.
    """
    found = simhash.near_copies(docs).where("doc_id is not null and doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    kept = docs.join(found.hint("merge"), docs["doc_id"] == found["_keep"], "left_semi")
    return kept.unionByName(docs.where(docs["doc_id"].isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of a benchmark item."""
    return decontam.decontaminate(held(docs, "text"), table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select("_row.*")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values by pseudonyms; n_chars follows the text."""
    out = pii.pseudonymise(held(docs, "text"), KEY)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048, release=True)


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", private), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        if k:
            removed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
