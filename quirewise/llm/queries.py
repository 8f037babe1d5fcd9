"""Registered queries: every operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.llm import align, ann, bpe, html, langid, lm, minhash, packing, quality, simhash, toxicity, trie, urls
from quirewise.llm.quality_sql import quality_sql
from quirewise.llm.trie_sql import trie_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.coded(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(_table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_tokens(_table(spark, sf_dir, "documents"))


def packed_tokens(documents: DataFrame) -> DataFrame:
    """Documents packed by their tokens in the byte-level vocabulary; the id after the last ends a document."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = packing.tokens(documents.sparkSession, ranks, public_tokenizers.PATTERN, len(ranks))
    coded = documents.select("doc_id", "text", ids("text").alias("ids"))
    return packing.packed(coded, length=F.octet_length("ids") / 4)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return langid.judged(documents, langid.fit(documents))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return toxicity.judged(documents, toxicity.fit(documents, _table(spark, sf_dir, "labels")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
    return align.weighed(_table(spark, sf_dir, "documents"), *of)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


_ALL = (
    op1_quality_rules,
    op2_fingerprints,
    op3_byte_bpe,
    op4_main_text,
    op5_url_filter,
    op6_lm_scoring,
    op7_simhash,
    op8_packing,
    op9_language,
    op10_toxicity,
    op11_token_alignment,
    op12_prefix_trie,
    op13_neighbours,
)
QUERIES = {query.__name__: query for query in _ALL}
#: The other operators learn models, hash, or follow links, which SQL doesn't express; their tests use brute force.
ORACLES = {"op1_quality_rules": quality_sql(), "op12_prefix_trie": trie_sql()}
