"""Suffix-array dedup: bytes in long strings that occur elsewhere are removed.

Sorting a suffix for every byte would move hundreds of times the input. Only suffixes at anchors are sorted: the
anchor of a window of ``length`` bytes is its gram with the least hash (the leftmost of equals), so equal windows
have their anchors at the same place, and windows whose anchor's gram occurs once occur once.

1. Anchors are found and counted; those whose gram occurs again keep the bytes of their windows, a segment.
2. Segments are range-partitioned by the bytes from the anchor on (Spark samples the splitters) and sorted; equal
   leading bytes never lie on both sides of a boundary, so no match crosses one.
3. For the segments of one gram, the suffixes from the anchor on and the reversed prefixes before it are sorted by
   multikey quicksort. A window with ``d`` bytes before the anchor occurs again if another segment has ``d`` bytes
   before and ``length - d`` after in common: both orders give classes of equal strings, which change only at the
   common lengths of neighbours.
4. A gram with more segments than a task should hold has its windows counted by their digests instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..session import cut_lineage
from .batches import bounded, slices
from .ngram_join import row_key
from .parts import n_parts, part_of, repeated_keys, text_bytes
from .words import _value, column_bytes, mixed, powers

LENGTH = 400
#: Bytes of a gram, at most; a quarter of the window in short ones.
GRAM = 64
#: Positions hashed at a time; below 2 ** 24, as a position shares a number with 40 bits of hash.
SPAN = 1 << 20
#: Segments of a gram that a task holds.
GROUP_SEGMENTS = 100_000
#: Rows that a task hands on at a time, about.
EMIT_ROWS = 20_000
#: Bytes compared at a time by the sort.
TOKEN = 16


def gram_size(length: int) -> int:
    return max(1, min(GRAM, length // 4))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``first, last, anchor, hash`` of each run of windows with the same anchor; windows lie inside one text."""
    gram = gram_size(length)
    width = length - gram + 1
    valid = np.zeros(len(data) + 1, np.int64)
    starts, ends = offsets[:-1], offsets[1:] - length + 1
    some = ends > starts
    np.add.at(valid, starts[some], 1)
    np.add.at(valid, ends[some], -1)
    valid = np.cumsum(valid)[:-1] > 0
    up, down = powers(min(SPAN, len(data)) + length)
    out = []
    for low in range(0, len(data), SPAN):
        part = data[low : low + SPAN + length - 1]
        n = len(part) - gram + 1
        count = len(part) - length + 1
        if count <= 0 or not valid[low : low + count].any():
            continue
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_value[part] * up[: len(part)], out=sums[1:])
        hashes = mixed((sums[gram:] - sums[:n]) * down[:n])
        keys = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
        rows = -(-n // width)
        blocks = np.full(rows * width, 0xFFFFFFFFFFFFFFFF, np.uint64)
        blocks[:n] = keys
        blocks = blocks.reshape(rows, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
        places = np.flatnonzero(valid[low : low + count])
        at = (least[places] & np.uint64(0xFFFFFF)).astype(np.int64)
        new = np.r_[True, (at[1:] != at[:-1]) | (np.diff(places) > 1)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(places)] - 1
        out.append((places[first] + low, places[last] + low, at[first] + low, hashes[at[first]]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _anchored(rows: DataFrame, length: int) -> DataFrame:
    """``key, first, last, anchor, gram`` for every run of windows of every row; places count from the text's start."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = column_bytes(part.column("text"))
                first, last, anchor, hashes = anchors(data, offsets, length)
                owner = np.searchsorted(offsets, first, "right") - 1
                start = offsets[owner]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(owner)), *(pa.array((x - start).astype(np.int32)) for x in (first, last, anchor)),
                     pa.array(hashes.view(np.int64))], ["key", "first", "last", "anchor", "gram"])

    return rows.select("key", "text").mapInArrow(run, "key bigint, first int, last int, anchor int, gram bigint")


def multikey_order(strings: list[bytes]) -> list[int]:
    """Places of the strings in sorted order: quicksort on tokens of ``TOKEN`` bytes, equal tokens sorted by the next."""
    out: list[int] = []
    work = [(list(range(len(strings))), 0)]
    while work:
        places, depth = work.pop()
        if len(places) < 2:
            out += places
            continue
        middle = places[len(places) // 2]
        pivot = strings[middle][depth : depth + TOKEN]
        less, same, more = [], [], []
        for i in places:
            token = strings[i][depth : depth + TOKEN]
            (less if token < pivot else more if token > pivot else same).append(i)
        work.append((more, depth))
        if len(pivot) < TOKEN:
            work.append((less, depth))
            # all of them end here
            work[-1:] = [([i], depth) for i in reversed(same)] + work[-1:]
        else:
            work.append((same, depth + TOKEN))
            work.append((less, depth))
    return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def _classes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the strings, and the common length of each with the one before (0 for the first)."""
    order = multikey_order(strings)
    lengths = [0] + [common(strings[a], strings[b]) for a, b in zip(order, order[1:])]
    return np.array(order), np.array(lengths)


def repeated(segments: list[tuple[bytes, int]], counts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For different segments of one gram (bytes, place of the anchor), the intervals of each that occur again.

    An interval joins all windows that overlap or touch; a segment that occurs more than once is repeated as a whole.
    """
    m = len(segments)
    low = [max(0, length - (len(s) - at)) for s, at in segments]  # bytes before the anchor, from ... to
    high = [at for _, at in segments]
    if m == 1:
        return [[(0, len(segments[0][0]))] if counts[0] > 1 else []]
    if m == 2:
        (a, i), (b, j) = segments
        after, before = common(a[i:], b[j:]), common(a[:i][::-1], b[:j][::-1])
        out = []
        for k, (s, at) in enumerate(segments):
            d0, d1 = (low[k], high[k]) if counts[k] > 1 else (max(low[k], length - after), min(high[k], before))
            out.append([(at - d1, at - d0 + length)] if d0 <= d1 else [])
        return out
    order_after, after = _classes([s[at:] for s, at in segments])
    order_before, before = _classes([s[:at][::-1] for s, at in segments])
    counts_, low_, high_ = np.array(counts), np.array(low), np.array(high)
    changes = np.unique(np.r_[low_, high_ + 1, length - after, before + 1])
    changes = changes[(changes >= low_.min()) & (changes <= high_.max() + 1)]
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    opened = np.full(m, -1, np.int64)  # where the run of repeated windows that goes on began, in bytes before the anchor

    def close(ended: np.ndarray, d1: int) -> None:
        for k in np.flatnonzero(ended & (opened >= 0)).tolist():
            at = segments[k][1]
            begin, end = at - d1, at - int(opened[k]) + length
            if out[k] and end >= out[k][-1][0]:
                out[k][-1] = (begin, out[k][-1][1])
            else:
                out[k].append((begin, end))
        opened[ended] = -1

    class_after, class_before = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for d0 in changes[:-1].tolist():
        # From d0 bytes before the anchor to the next change, classes are the same and a segment has all these windows or none.
        holds = (low_ <= d0) & (high_ >= d0)
        class_after[order_after] = np.cumsum(after < length - d0)
        class_before[order_before] = np.cumsum(before < d0)
        _, inverse = np.unique(class_after * (m + 1) + class_before, return_inverse=True)
        again = holds & (np.bincount(inverse, np.where(holds, counts_, 0))[inverse] > 1)
        close(~again, d0 - 1)
        opened[again & (opened < 0)] = d0
    close(np.ones(m, bool), int(changes[-1]) - 1)
    return out


SEGMENT = "lead binary, content binary, anchor int, keys binary, starts binary"


def _segments(rows: DataFrame, found: DataFrame, length: int, parts: int) -> DataFrame:
    """``lead, content, anchor, keys, starts``: different segments of a part of the texts, and where they occur."""
    gram = gram_size(length)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        places = {c: right[c].to_numpy() for c in ("key", "first", "last", "anchor")}
        order = np.argsort(places["key"], kind="stable")
        places = {c: x[order] for c, x in places.items()}
        seen: dict[tuple[bytes, int], list[tuple[int, int]]] = {}
        if len(order):
            for key, text in zip(left["key"].to_pylist(), left["text"]):
                a, b = np.searchsorted(places["key"], key, "left"), np.searchsorted(places["key"], key, "right")
                if a == b:
                    continue
                data = text.as_py().encode()
                runs = {(f, l, q) for f, l, q in zip(*(places[c][a:b].tolist() for c in ("first", "last", "anchor")))}
                for f, l, q in runs:
                    seen.setdefault((data[f : l + length], q - f), []).append((key, f))
        items = list(seen.items())
        return pa.table({
            "lead": pa.array([c[at : at + gram] for (c, at), _ in items], pa.binary()), "content": pa.array([c for (c, _), _ in items], pa.binary()),
            "anchor": pa.array([at for (_, at), _ in items], pa.int32()),
            "keys": pa.array([np.array([k for k, _ in x], "<i8").tobytes() for _, x in items], pa.binary()),
            "starts": pa.array([np.array([f for _, f in x], "<i4").tobytes() for _, x in items], pa.binary())})

    part = lambda df: df.withColumn("part", part_of(F.col("key"), parts)).groupBy("part")
    return part(rows.select("key", "text")).cogroup(part(found)).applyInArrow(cut, SEGMENT)


def _judged(segments: DataFrame, length: int, n_ranges: int, most: int) -> DataFrame:
    """``key, start, end`` of repeated intervals; the segments of grams with more than ``most`` come out as they are, with ``content``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, held, full = None, [], False
        spans: list[tuple[np.ndarray, ...]] = []
        rest: list[tuple] = []
        waiting = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            merged: dict[tuple[bytes, int], list] = {}
            for row in held:
                merged.setdefault((row["content"], row["anchor"]), []).append(row)
            places = [[(np.frombuffer(r["keys"], "<i8"), np.frombuffer(r["starts"], "<i4")) for r in rows] for rows in merged.values()]
            counts = [sum(len(k) for k, _ in x) for x in places]
            if sum(counts) < 2:
                return
            for intervals, where in zip(repeated(list(merged), counts, length), places):
                for a, b in intervals:
                    for keys, starts in where:
                        spans.append((keys, starts + np.int32(a), starts + np.int32(b)))
                        waiting += len(keys)
                        if waiting >= EMIT_ROWS:
                            yield emit_spans()

        def passed(row: dict) -> Iterator[pa.RecordBatch]:
            keys, starts = np.frombuffer(row["keys"], "<i8").tolist(), np.frombuffer(row["starts"], "<i4").tolist()
            rest.extend((k, s, None, row["content"], row["anchor"]) for k, s in zip(keys, starts))
            if len(rest) >= EMIT_ROWS:
                yield emit_rest()

        def emit_spans() -> pa.RecordBatch:
            nonlocal waiting
            columns = [pa.array(np.concatenate(c)) for c in zip(*spans)] if spans else [pa.array([], t) for t in kinds[:3]]
            n = len(columns[0])
            spans.clear()
            waiting = 0
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, kinds[3]), pa.nulls(n, kinds[4])], names)

        def emit_rest() -> pa.RecordBatch:
            columns = list(zip(*rest)) if rest else [[]] * 5
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
            rest.clear()
            return made

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
        names = ["key", "start", "end", "content", "anchor"]
        for batch in batches:
            for row in batch.to_pylist():
                if row["lead"] != lead:
                    yield from close()
                    lead, held, full = row["lead"], [], False
                if not full and len(held) == most:
                    for r in held:
                        yield from passed(r)
                    held, full = [], True
                if full:
                    yield from passed(row)
                else:
                    held.append(row)
        yield from close()
        yield emit_spans()
        yield emit_rest()

    ordered = segments.repartitionByRange(n_ranges, "lead").sortWithinPartitions("lead")
    return ordered.mapInArrow(run, "key bigint, start int, end int, content binary, anchor int")


def _counted_windows(rest: DataFrame, length: int) -> DataFrame:
    """``key, start, end`` of the windows of segments that occur again, by digests of all their windows."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                content = row["content"]
                places = range(len(content) - length + 1)
                digests = [hashlib.blake2b(content[p : p + length], digest_size=16).digest() for p in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array([row["key"]] * len(places), pa.int64()),
                     pa.array([row["start"] + p for p in places], pa.int32())], ["digest", "key", "start"])

    every = rest.select("key", "start", "content").mapInArrow(spread, "digest binary, key bigint, start int")
    again = every.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    return every.join(again, "digest").select("key", "start", (F.col("start") + length).alias("end"))


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
    carry: tuple[str, ...] = (), group_segments: int = GROUP_SEGMENTS,
) -> DataFrame:
    """``row_key, <id>, n_bytes, n_removed, n_spans, kept, text, carried`` for each row.

    A text is its UTF-8 bytes. Every byte in a string of ``length`` bytes that also starts at any other place, in
    the same or another row, is removed, all occurrences alike; overlaps count and strings are judged on the input.
    ``n_spans`` counts the maximal removed runs, ``kept`` holds the bytes that remain, ``text`` the same without
    characters that lost some of their bytes. ``row_key`` is a hash of id and text.

    A null counts as empty; shorter texts keep all. Repeated rows repeat each other, whatever their id, and stay
    repeated; a row without an id takes part. An empty table gives no rows. The columns named in ``carry`` come
    along in the struct ``carried``; others are left out. A task holds ``group_segments`` segments of a gram at most.
    """
    carried = F.struct(F.lit(True).alias("_row"), *(F.col(c) for c in carry)).alias("carried")
    every = bounded(docs).select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), carried)
    rows = every.drop("carried")
    parts = n_parts(text_bytes(rows))
    places = cut_lineage(_anchored(rows, length))
    found = repeated_keys(places, "gram").select("key", "first", "last", "anchor")
    ranges = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    judged = cut_lineage(_judged(_segments(rows, found, length, parts), length, ranges, group_segments))
    spans = judged.where("content IS NULL").select("key", "start", "end")
    spans = spans.unionByName(_counted_windows(judged.where("content IS NOT NULL"), length))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, starts, ends = (right[c].to_numpy() for c in ("key", "start", "end"))
        order = np.lexsort((starts, keys))
        keys, starts, ends = keys[order], starts[order], ends[order]
        out = []
        for key, text in zip(left["key"].to_pylist(), left["text"]):
            data = text.as_py().encode()
            a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            if a == b:
                out.append((len(data), 0, 0, data, data.decode()))
                continue
            s, reach = starts[a:b], np.maximum.accumulate(ends[a:b])
            new = np.flatnonzero(np.r_[True, s[1:] > reach[:-1]])
            begin, end = s[new], reach[np.r_[new[1:] - 1, len(s) - 1]]
            kept = b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(data)]))
            out.append((len(data), len(data) - len(kept), len(new), kept, kept.decode("utf-8", "ignore")))
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        names = ["row_key", "id", "carried", "n_bytes", "n_removed", "n_spans", "kept", "text"]
        return pa.table([left["key"], left["id"], left["carried"], *(pa.array(c, t) for c, t in zip(columns, kinds))], names=names)

    schema = StructType([StructField("row_key", LongType()), StructField("id", docs.schema[id_col].dataType), every.schema["carried"]])
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, LongType())
    schema = schema.add("kept", BinaryType()).add("text", StringType())
    part = lambda df: df.withColumn("part", part_of(F.col("key"), parts)).groupBy("part")
    return part(every).cogroup(part(spans)).applyInArrow(apply, schema).withColumnRenamed("id", id_col)
