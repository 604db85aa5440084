"""Texts dealt out to parts of bounded bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of text in a part, about.
PART_BYTES = 8_000_000


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("bigint"))).first()[0] or 0


def n_parts(total: int) -> int:
    """A prime, so that ids with a common factor don't fall into a few parts."""
    n = max(3, total // PART_BYTES) | 1
    while any(n % d == 0 for d in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


#: So many keys may be broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def with_keys(rows: DataFrame, keys: DataFrame, how: str, key: str = "row_key") -> DataFrame:
    """Rows joined with a written table of keys; their texts stay where they are if the keys are few."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, key, how)


#: A key with more than this share of all rows is joined by a broadcast; there are 10,000 of them at most.
HOT_SHARE = 10_000


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """The rows of a written table whose ``key`` occurs again. Hot keys don't meet in one task."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    limit = rows.count() // HOT_SHARE
    hot = F.broadcast(counts.where(F.col("_n") > limit).select(key))
    rest = rows.join(hot, key, "left_anti").join(counts.where(F.col("_n") <= limit).select(key), key, "left_semi")
    return rows.join(hot, key, "left_semi").unionByName(rest)


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(key, F.lit(parts)).cast("int")
