"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import BIN_ROWS, per_source, running_total, source_key, uniform


def interleave(rows: DataFrame, n_shards: int, seed: int = 1) -> DataFrame:
    """``shard`` and ``slot`` for each row of a table with ``doc_id, source, size, text_crc32``.

    Rows are shuffled by seed within their source; row ``r`` of ``n`` gets the fraction ``(r - 1/2) / n``; all
    rows sorted by fraction are cut into ``n_shards`` runs whose lengths differ by one at most. Each run holds
    every source in the proportion of the whole. A slot is the row's place in its shard, from 0 without gaps.

    Both orders are formed in bins (see ``running_total``), so neither a hot source nor the whole table is sorted
    in one task. Nulls: a null source is a source; other nulls take part as they are. Rows that are alike in all
    four columns may swap places. With fewer rows than shards some shards stay empty.
    """
    names = ["doc_id", "source", "size", "text_crc32"]
    chance = uniform(seed, F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    rows = rows.select(*names, source_key().alias("_group"), chance.alias("_u"))
    counts = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    order = [F.col(c) for c in ("_u", "doc_id", "text_crc32", "size")]
    ranked = running_total(per_source(rows, counts, F.col("_u")), "_group", F.col("_u"), order, F.lit(1), "_before")
    fraction = (F.col("_before") + 0.5) / F.col("_rows")
    ranked = cut_lineage(ranked.select(*names, "_group", fraction.alias("_fraction")))

    total = ranked.agg(F.count(F.lit(1)).alias("_rows"))
    n_bins = F.floor(F.col("_rows") / BIN_ROWS) + 1
    binned = ranked.crossJoin(F.broadcast(total)).withColumn("_bin", F.floor(F.col("_fraction") * n_bins))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    starts = bins.select("_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bin").orderBy("_fraction", "_group", "doc_id", "text_crc32", "size"))
    placed = binned.join(starts, "_bin").withColumn("_at", F.col("_start") + inside - 1)
    shard = F.expr(f"(_at * {n_shards}) div _rows")
    first = F.expr(f"(shard * _rows + {n_shards - 1}) div {n_shards}")
    placed = placed.withColumn("shard", shard).withColumn("slot", F.col("_at") - first)
    return placed.select(*names, F.col("shard").cast("int"), F.col("slot").cast("bigint"))


def measured(docs: DataFrame, per_row: int = 16) -> DataFrame:
    """``doc_id, source, size, text_crc32`` of documents, written once: UTF-8 bytes plus ``per_row``, and the checksum.

    A null text has no bytes, and the checksum 0 of an empty one.
    """
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = (F.octet_length(data) + per_row).cast("bigint")
    return cut_lineage(docs.select("doc_id", "source", size.alias("size"), F.crc32(data).alias("text_crc32")))
