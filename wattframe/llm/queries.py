"""The operators of this subpackage as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, language, licenses, mixing, ngram_join, repair, sharding, substring, suffixes, token_counts, topk, trie
from .common import table, word_count


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 largest inner products of whole-number vectors for every twentieth row."""
    from .vectors import usable

    rows = table(spark, folder, "embeddings")
    rows = rows.where(usable(F.col("embedding").cast("array<double>")))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 64).cast("double"))
    rows = rows.select("vec_id", whole.alias("vector"))
    return topk.exact_top_k(rows.where("vec_id % 20 = 0"), rows, 20)


def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest rows by cosine for every fiftieth row."""
    rows = table(spark, folder, "embeddings")
    return ann.nearest(rows.where("vec_id % 50 = 0"), rows, 5, vector_col="embedding")


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and back; digests of both."""
    import public_tokenizers

    how = (_public("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.decode(bpe.encode(table(spark, folder, "documents"), *how), *how)
    return rows.select(
        "doc_id", F.expr("CAST(octet_length(ids) div 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"),
    )


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents that share 85 of 100 four-word shingles."""
    rows = ngram_join.near_duplicates(table(spark, folder, "documents"), size=4, share=(85, 100))
    return rows.select("doc_id", "n_shingles", "component_id")


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every page, by a model of the documents' languages."""
    model = language.fit(table(spark, folder, "documents"))
    rows = language.identify(language.page_rows(table(spark, folder, "pages")), model)
    return rows.withColumnRenamed("key", "page_id").withColumn("probability", F.round("probability", 6))


def op6_substring(spark: SparkSession, folder: str) -> DataFrame:
    """Words that stay when windows of 13 words that an earlier document has are removed."""
    rows = substring.remove_repeats(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op9_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes that stay when all strings of 400 bytes that occur elsewhere are removed."""
    rows = suffixes.remove_repeats(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, and whether they are more than 512."""
    rows = token_counts.token_counts(table(spark, folder, "documents"), _public("byte_bpe_50k.json"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 512)


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of each document."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return mixing.mix(mixing.measured(docs, word_count(F.col("text")), labels)).drop("source")


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in 40 shards of equal row counts, each with the mixture of the whole."""
    placed = sharding.interleave(sharding.measured(table(spark, folder, "documents")), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases of licenses in every document, and the labels of license notices that its blocks resemble."""
    rows = licenses.scan(table(spark, folder, "documents"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    labels = F.array_sort(F.array_distinct(F.concat("places.label", "blocks.label")))
    share = F.array_max(F.transform("blocks", lambda b: b["shared"] / b["size"]))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.first_word").alias("first_word"), F.array_max("places.first_word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
    )


def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after some of its turns were damaged."""
    return repair.repair(repair.damage(table(spark, folder, "conversations")))


def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every beginning that conversations share once they were rebuilt from the first of twenty."""
    return trie.trie(*trie.rebuilt(table(spark, folder, "conversations"))).drop("said")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
