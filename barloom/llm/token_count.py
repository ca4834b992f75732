"""Token counts with a cache keyed by digests of content and tokenizer version."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import bound_batches, staged
from barloom.llm.encode import encoder

_models: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    """Of the vocabulary file and the library's version: another version never reads this one's counts."""
    name = "sentencepiece" if path.endswith(".model") else "tokenizers"
    from importlib.metadata import version

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{name} {version(name)}".encode()).hexdigest()


def counts(texts: list[str], path: str) -> list[int]:
    if path.endswith(".model"):
        if path not in _models:
            import sentencepiece

            _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(ids) for ids in _models[path].encode(texts, num_threads=1)]
    return [len(raw) // 4 for raw in encoder(path).encode_all(texts)]


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    try:
        stored = spark.read.parquet(cache)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit), one row for each input row.

    Content is normalised only as far as counts cannot change: null counts as empty. Each distinct content that the
    cache lacks is encoded once, however many rows hold it, and its count is appended to the cache as Parquet by
    Spark's committer, so a lost executor leaves no half-written count. Counts are joined back on the digest. They are
    written for that, each digest once: the join then shares its stage with no aggregate, and Spark splits the rows of a
    very common text among tasks.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    version = tokenizer_digest(tokenizer)
    content = F.coalesce(F.col(text), F.lit(""))
    each = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"), F.octet_length(content).cast("long").alias("n_bytes"))
    texts = docs.select(F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"), content.alias("text"))
    stored = read_cache(spark, cache, version)
    misses = texts.groupBy("digest").agg(F.first("text").alias("text"))
    if stored is not None:
        misses = misses.join(stored, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = counts(b.column("text").to_pylist(), tokenizer)
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(np.array(n, np.int64))], ["digest", "n_tokens"])

    misses.mapInArrow(encode, "digest binary, n_tokens long").withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    found = read_cache(spark, cache, version)
    found = spark.createDataFrame([], "digest binary, n_tokens long") if found is None else staged(found, "counts")
    return each.join(found, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
