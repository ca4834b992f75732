"""One query for each operator, over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import align, decontam, embed_dedup, html_text, langid, packing, pii, simhash, suffix_dedup, token_codes, token_count, toxicity, variants
from barloom.llm.common import fold_of, scratch, table

TOKENIZER = "byte_bpe_50k.json"
#: Of the pseudonyms, for demonstration; give your own and keep it.
KEY = "query-demonstration-key"


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1, capacity=2048)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), threshold=400).drop("kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold=0, folds=5)
    score = F.col("tox_score")
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op6_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-codes")
    token_codes.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), end_id=2)
    return token_codes.read_documents(spark, path, with_ids=False)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.classify(table(spark, sf_dir, "documents"), fold=2)
    return out.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, shingle=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), KEY).select("doc_id", "text", "n_values")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, after an earlier batch (an eighth of them) has been counted: what it shares with the rest is read from the cache."""
    docs, path, cache = table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), scratch(spark, "token-counts")
    token_count.count_tokens(docs.where(fold_of("doc_id", 8) == 0), path, cache, limit=1024)
    return token_count.count_tokens(docs, path, cache, limit=1024)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path("piece_bpe_32k.model"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages)).select("page_id", "url", "text", "n_chars")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_embedding_near_dedup, op2_packing, op3_suffix_dedup, op4_toxicity, op5_decontamination, op6_token_codes, op7_language_id, op8_simhash, op9_pii, op10_token_counts, op11_token_alignment, op12_spelling_variants, op13_html_text, pipeline]
    return {f.__name__: f for f in found}


#: Pairs of equal label by cosine, then the smallest id that links lead to.
OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(id, root) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT link.a, reach.root FROM reach JOIN link ON link.b = reach.id
), component AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(vec_id = coalesce(root, vec_id), false) AS kept
FROM embeddings LEFT JOIN component ON id = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) ON a = vec_id
"""

#: Windows of documents and items as word lists of equal length, joined on equality.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[k : k + least(len(ws), 10) - 1], ' ') AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM i WHERE len(ws) > 0)
), hit AS (
  SELECT doc_id, k, n, item_id FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win)) x JOIN win USING (n) WHERE array_to_string(ws[k : k + n - 1], ' ') = w
), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1_SQL, "op5_decontamination": OP5_SQL}
