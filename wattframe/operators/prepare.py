"""Cleaning and regrouping readings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import clean_double
from ..functions.timegrid import epoch_exact
from .align import BLOCK_SECONDS
from .blocks import TIME_BLOCK, time_blocks

# Raw production types of each category.
CATEGORIES = {
    "actual_load": ["Actual Load"],
    "hard_coal": ["Fossil Hard coal Actual Aggregated"],
    "lignite": ["Fossil Brown coal/Lignite Actual Aggregated"],
    "gas": ["Fossil Gas Actual Aggregated"],
    "other_fossil": [
        "Fossil Coal-derived gas Actual Aggregated",
        "Fossil Oil Actual Aggregated",
        "Other Actual Aggregated",
    ],
    "nuclear": ["Nuclear Actual Aggregated"],
    "biomass": ["Biomass Actual Aggregated"],
    "waste": ["Waste Actual Aggregated"],
    "other_renewable": ["Geothermal Actual Aggregated", "Other renewable Actual Aggregated"],
    "hydro": [
        "Hydro Pumped Storage Actual Aggregated",
        "Hydro Run-of-river and poundage Actual Aggregated",
        "Hydro Water Reservoir Actual Aggregated",
    ],
    "solar": ["Solar Actual Aggregated"],
    "wind_onshore": ["Wind Onshore Actual Aggregated"],
    "wind_offshore": ["Wind Offshore Actual Aggregated"],
}
# Nulls of these series become a constant before interpolation.
CONSTANT_FILL = {"Nuclear Actual Aggregated": 0.0}
CONSUMPTION = "Consumption"


def as_float(df: DataFrame) -> DataFrame:
    """Values as ``DOUBLE``, NaN as null (P-02)."""
    return df.withColumn("value", clean_double("value"))


def fill_constant(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    """Replace the nulls of the named series by a constant (P-03)."""
    if not fills:
        return df
    constants = F.create_map(*chain.from_iterable((F.lit(s), F.lit(float(v))) for s, v in fills.items()))
    return df.withColumn("value", F.coalesce("value", F.try_element_at(constants, F.col("series"))))


def drop_matching(df: DataFrame, pattern: str = CONSUMPTION) -> DataFrame:
    """Drop the series whose name matches ``pattern`` (P-05)."""
    return df.where(~F.col("series").rlike(pattern))


def interpolate_time(df: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Fill nulls linearly by elapsed time (F-02).

    Leading nulls stay null, trailing nulls take the last value, known values
    do not change. Work is split by ``(area, series, block of time)``. What
    crosses a border - the last value known before a block and the first one
    known after it - comes from a summary of one row per block. Choose
    ``block_seconds`` so that a block of one series holds some thousand rows;
    the default suits quarter-hours and hours. Rows that ``align`` has already
    put into blocks are used as they lie.
    """
    keys = ["area", "series", TIME_BLOCK]
    blocked = df if TIME_BLOCK in df.columns else time_blocks(df, block_seconds)
    rows = blocked.select("area", "series", "ts", "value", TIME_BLOCK)
    seen = F.when(F.col("value").isNotNull(), F.col("ts"))

    # Same columns and partitioning as the rows, so the summary adds no shuffle
    # of rows.
    edges = rows.groupBy(*keys).agg(
        F.min(seen).alias("_t0"), F.min_by("value", seen).alias("_v0"),
        F.max(seen).alias("_t1"), F.max_by("value", seen).alias("_v1"),
    )
    # "Everything before" in both directions: a frame up to the end of the
    # partition would be evaluated anew for every row.
    forward = Window.partitionBy("area", "series").orderBy(TIME_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy("area", "series").orderBy(F.desc(TIME_BLOCK)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = edges.select(
        *keys,
        F.last("_t1", True).over(forward).alias("_bt"), F.last("_v1", True).over(forward).alias("_bv"),
        F.last("_t0", True).over(backward).alias("_at"), F.last("_v0", True).over(backward).alias("_av"),
    )

    def nearest(side: str, column: str) -> Column:
        """``column`` of the next known row on one side, inside the block."""
        order = f"PARTITION BY area, series, {TIME_BLOCK} ORDER BY ts"
        return F.expr(f"{side}({column}) IGNORE NULLS OVER ({order})")

    spanned = rows.withColumn("_seen", seen).join(carried, keys, "left").withColumns({
        "_pt": F.coalesce(nearest("lag", "_seen"), "_bt"),
        "_pv": F.coalesce(nearest("lag", "value"), "_bv"),
        "_nt": F.coalesce(nearest("lead", "_seen"), "_at"),
        "_nv": F.coalesce(nearest("lead", "value"), "_av"),
    })
    start = epoch_exact("_pt")
    share = (epoch_exact("ts") - start) / (epoch_exact("_nt") - start)
    filled = (
        F.when(F.col("value").isNotNull(), F.col("value"))
        .when(F.col("_pt").isNull(), F.lit(None).cast("double"))
        .when(F.col("_nt").isNull(), F.col("_pv"))
        .otherwise(F.col("_pv") + (F.col("_nv") - F.col("_pv")) * share)
    )
    return spanned.select("area", "ts", "series", filled.alias("value"))


def map_categories(
    df: DataFrame, categories: dict[str, list[str]] = CATEGORIES, block_seconds: int = BLOCK_SECONDS
) -> DataFrame:
    """Sum the member series of each category per timestamp (P-06).

    One null member makes the sum null; a member that does not exist at all is
    ignored; series outside the mapping pass through. Needs aligned rows. The
    shuffle is by category and block of time, so neighbouring timestamps stay
    together and a later mean per bin is mostly formed before its own shuffle.
    """
    pairs = [(F.lit(member), F.lit(name)) for name, members in categories.items() for member in members]
    target = F.coalesce(F.try_element_at(F.create_map(*chain.from_iterable(pairs)), F.col("series")), F.col("series"))
    named = df.select("area", "ts", target.alias("series"), "value")
    return (
        time_blocks(named, block_seconds)
        .groupBy("area", "series", TIME_BLOCK, "ts")
        .agg(F.when(F.count("*") == F.count("value"), F.sum("value")).alias("value"))
        .select("area", "ts", "series", "value")
    )


def category_order(names: list[str], categories: dict[str, list[str]] = CATEGORIES) -> list[str]:
    """Column order of the wide frame: unmapped series first, then the categories in mapping order."""
    return [n for n in names if n not in categories] + [c for c in categories if c in names]
