"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import per_source, running_total, source_key, uniform

#: Sources in code point order weigh so, over and over.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source's text is taken so many times at most.
MAX_EPOCHS = 3


def source_targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, _rows, source_size, target`` with one row per source.

    The total size is shared by weight; no target exceeds ``max_epochs`` times its source's size, and what is
    over goes to the other sources by weight. The sources that stop at their cap are those with the least cap per
    weight, so the water level follows from sums over sources in that order. Only here all sources meet in a task.
    """
    sources = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    sources = sources.withColumn("_weight", weight).withColumn("_cap", cap)
    by_level = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").isNull(), "source")
    before, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    sources = sources.withColumn("_level", left / F.sum("_weight").over(rest))
    level = F.max(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))).over(everything)
    target = F.least(F.col("_cap"), F.coalesce(level * F.col("_weight"), F.col("_cap")))
    return sources.select("source", "_rows", "source_size", target.alias("target"))


def mix(rows: DataFrame, seed: int = 1, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """How often the mix takes each row of ``doc_id, source, size, quality``.

    Adds ``source_size, target, copies, taken`` (``copies * size``). A source gives as many complete epochs as fit
    into its target; the rest comes from the rows with the smallest exponential keys ``-ln(u) / quality``, up to
    the row whose middle lies beyond the budget. ``u`` depends on seed and ``doc_id``, so reruns agree.

    Nulls: a null source is a source of its own, last; a null size counts 0; a quality that is null counts 1, one
    that is not above 0 (or not a number) comes after all others. Rows of size 0 take nothing. Rows that share an
    id are rows of their own. An empty table gives no rows. Other columns do not take part.
    """
    quality = F.coalesce(F.col("quality").cast("double"), F.lit(1.0))
    rows = rows.select(
        "doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size"),
        F.when(quality.between(1e-9, 1e9), quality).alias("_quality"), uniform(seed, F.col("doc_id")).alias("_u"),
    )
    targets = source_targets(rows, weights, max_epochs).withColumn("_group", source_key()).drop("source")
    joined = per_source(rows.withColumn("_group", source_key()), targets, F.col("_u"))
    key = -F.log("_u") / F.col("_quality")
    place = F.when(F.col("_quality").isNotNull(), F.lit(0.999) * (1 - F.exp(-key))).otherwise(F.lit(0.999) + F.col("_u") / 1000)
    joined = joined.withColumn("_place", place)
    order = [F.col("_place"), F.col("doc_id"), F.col("size")]
    placed = running_total(joined, "_group", F.col("_place"), order, F.col("size"), "_before")
    epochs = F.least(F.floor(F.col("target") / F.col("source_size") + 1e-9), F.lit(max_epochs))
    budget = F.when(epochs < max_epochs, F.col("target") - epochs * F.col("source_size")).otherwise(F.lit(0.0))
    extra = (F.col("_before") + F.col("size") / 2 <= budget).cast("int")
    copies = F.when((F.col("source_size") > 0) & (F.col("size") > 0), epochs + extra).otherwise(F.lit(0))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("bigint").alias("taken"),
    )


def measured(docs: DataFrame, size: Column, labels: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, size, quality`` of documents, written once so that their texts are read once.

    ``labels`` (``doc_id, quality`` 0 or 1) weigh a document 2 or one half; one without a label weighs 1.
    """
    rows = docs.select("doc_id", "source", size.alias("size"))
    if labels is None:
        return cut_lineage(rows.withColumn("quality", F.lit(1.0)))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("_label"))
    weight = F.when(F.col("_label") >= 1, 2.0).when(F.col("_label") < 1, 0.5).otherwise(1.0)
    return cut_lineage(rows.join(known, "doc_id", "left").select("doc_id", "source", "size", weight.alias("quality")))
