"""From raw documents to token ids, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.llm import bpe, language, mixing, ngram_join, suffixes
from wattframe.llm.common import table, word_count
from wattframe.llm.parts import with_keys
from wattframe.session import cut_lineage, owned_cuts


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row_key", ngram_join.row_key("doc_id", "text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and is in one of the known languages; ``lang`` becomes the one found.

    The document's ``lang`` counts as declared, its source as the host. Rows with the same id and text are judged alike.
    """
    columns = docs.columns
    rows = _keyed(docs)
    asked = rows.select(F.col("row_key").alias("key"), "text", F.col("lang").alias("declared"), F.lit(None).alias("suffix"),
                        F.lit(None).alias("domain"), F.col("source").alias("host"))
    found = cut_lineage(language.identify(asked, language.fit(docs)).withColumnRenamed("key", "row_key"))
    out = cut_lineage(found.where("rejected").select("row_key").distinct())
    changed = cut_lineage(found.where("NOT rejected").join(rows.select("row_key", F.col("lang").alias("_was")).distinct(), "row_key")
                          .where("NOT (lang <=> _was)").groupBy("row_key").agg(F.min("lang").alias("_lang")))
    kept = with_keys(with_keys(rows, out, "left_anti"), changed, "left")
    return kept.withColumn("lang", F.coalesce("_lang", "lang")).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 of 100 five-word shingles: the one with the smallest id."""
    columns = docs.columns
    found = cut_lineage(ngram_join.near_duplicates(docs).where("component IS NOT NULL"))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("_first"))
    stay = first.select(F.col("_first.row_key").alias("row_key"))
    out = cut_lineage(found.select("row_key").distinct().join(stay, "row_key", "left_anti"))
    again = cut_lineage(found.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_key"))
    kept = with_keys(_keyed(docs), out, "left_anti")
    once = with_keys(kept, again, "left_semi").dropDuplicates(["row_key"])  # rows that are alike in id and text
    return with_keys(kept, again, "left_anti").unionByName(once).select(*columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes that occur elsewhere; a document that loses everything goes."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    rows = suffixes.remove_repeats(docs, carry=others).where("n_removed < n_bytes OR n_bytes = 0")
    rows = rows.select("doc_id", "text", *(F.col(f"carried.{c}") for c in others)).withColumn("n_chars", F.length("text").cast("bigint"))
    return rows.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; labels of quality weigh the drawing."""
    rows = _keyed(docs)
    labels = rows.select("doc_id", "row_key").join(table(spark, sf_dir, "labels").where("doc_id IS NOT NULL"), "doc_id")
    labels = labels.select(F.col("row_key").alias("doc_id"), "quality")
    sizes = mixing.measured(rows.select(F.col("row_key").alias("doc_id"), "source", "text"), word_count(F.col("text")), labels)
    taken = mixing.mix(sizes).where("copies > 0").groupBy(F.col("doc_id").alias("row_key")).agg(F.max("copies").alias("_copies"))
    chosen = with_keys(rows, cut_lineage(taken), "inner")
    return chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids``: every text's token ids, packed as little-endian unsigned 32-bit integers."""
    rows = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc_id", F.expr("CAST(octet_length(ids) div 4 AS BIGINT)").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_id), ("near_duplicates", near_duplicates), ("suffixes", suffix_dedup), ("mix", mix_sources), ("tokens", token_ids),
]

#: BPE ids and the sampled mix are not for SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all that the one before it kept; each result is written and read again.

    What a stage writes on its way is removed when its result is there.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with owned_cuts(spark):
            docs = cut_lineage(stage(spark, docs, sf_dir), owned=False)
    return docs
