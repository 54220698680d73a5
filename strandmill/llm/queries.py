"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import bpe, langid, neardup, packing, pii, repair, tokenfile, toxicity, triejoin, urltree, vectors, whitening
from strandmill.llm.shared import shared_folder, table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no ids; repeated rows are encoded each; a text of any length is encoded whole."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), _pattern(), then=bpe.DIGESTS)


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, zero and non-finite vectors take no part; repeated rows are found each; only vectors of the query's length are compared."""
    return vectors.forest_search(_embeddings(spark, sf_dir), F.col("id") % 20 == 0, k=20)


def op4_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and non-finite vectors take no part; repeated rows are found each; ties go to the smaller vec_id."""
    return vectors.threshold_search(_embeddings(spark, sf_dir), F.col("id") % 20 == 0, k=20, transform=_grid)


def _grid(x: np.ndarray) -> np.ndarray:
    return np.floor(64 * x)


RULES = [urltree.Rule("block", "com", "/en/"), urltree.Rule("allow", "example.com", "/en/7"), urltree.Rule("allow", "net", "/de/"), urltree.Rule("block", "example.net", "/de/8"), urltree.Rule("block", "org", "/es/")]


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null url, or one without ://, has an empty host and path and is judged by the method; repeated urls are judged alike."""
    return urltree.judged_urls(table(spark, sf_dir, "pages"), RULES).withColumnRenamed("id", "page_id")


#: The key of the surrogates in the registered queries; a deployment passes its own.
KEY = b"surrogates of the registered queries"


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts stay; the same entity has the same surrogate in every row."""
    found = pii.with_surrogates(table(spark, sf_dir, "documents"), KEY)
    return found.select("doc_id", "text", F.size("entities").alias("n_entities"), F.to_json("entities").alias("entities"))


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no shingles and stay alone; a null doc_id is its own null component; rows that share a doc_id count as one document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are their end id alone; rows of equal or null doc_ids stand side by side, null first."""
    path = f"{shared_folder(spark)}/token-file-{uuid.uuid4().hex[:12]}"
    tokenfile.write_token_file(table(spark, sf_dir, "documents"), path, _vocabulary("byte_bpe_50k.json"), _pattern(), end=2)
    return tokenfile.located(spark, path)


def _fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have a score too; null doc_ids are not held out; rows that share a doc_id are scored each."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), only=_fold(5) != 0)
    return toxicity.score_documents(docs, model).select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and those without a letter are und; null doc_ids are not held out; rows that share a doc_id are predicted each."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs, only=_fold(3) != 1))
    return found.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are their end id alone; rows that share a doc_id are documents of their own."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), window=2048, end=1, then=packing.DIGESTS)


def op11_residue_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null vectors, empty ones and those with null or non-finite entries give no row; a deviation beyond 64 bits is the greatest 64-bit number."""
    found = whitening.whitened(_embeddings(spark, sf_dir), scale=256, components=4)
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.least("deviation", F.lit(whitening.MOST)).cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op12_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no shingles and stay alone; rows that share a doc_id are rows of their own."""
    return triejoin.jaccard_join(table(spark, sf_dir, "documents"), words=5, percent=80)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null conv_id is a conversation of its own; rows of the same turn go by role and text."""
    return repair.repair(repair.tampered(table(spark, sf_dir, "conversations")), gone=F.col("gone"), digest=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_transducer, op2_prefix_forest, op3_token_file, op4_threshold_top_k, op5_url_templates, op6_surrogates, op7_toxicity, op8_circulant_minhash, op9_language, op10_best_fit_packing, op11_residue_whitening, op12_prefix_tree_join, op13_conversation_repair)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOP_SQL = """
WITH e AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score
  FROM e AS q JOIN e ON e.vec_id <> q.vec_id AND len(e.v) = len(q.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

NEAR_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets), each AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN least ON least.a = n.doc_id
"""


JOIN_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets), each AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), many AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM n JOIN least ON least.a = n.doc_id LEFT JOIN many ON many.a = n.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express; the other operators are tested against brute force, round trips or held-out rows."""
    return {"op4_threshold_top_k": TOP_SQL, "op8_circulant_minhash": NEAR_SQL, "op12_prefix_tree_join": JOIN_SQL}
