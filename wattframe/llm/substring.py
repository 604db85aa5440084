"""Substring dedup: words in windows that an earlier document has are removed.

Every window of a fixed number of words is hashed (Rabin-Karp). A task sends each hash of a batch once, with the
least document that has it, to the hash's bucket; the bucket finds the least document of all. Verdicts go back to
their documents, where windows judged so merge into maximal removal intervals.

A hash has 64 bits: among ``n`` different windows about ``n * n / 2 ** 65`` pairs are equal by chance, 0.0003 among
100 million.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .batches import bounded, slices
from .parts import n_parts, part_of, text_bytes
from .words import windows, words

WINDOW = 13
#: Windows that a task compares at a time, and windows of a bucket, about.
BATCH_WINDOWS = 2_000_000
BUCKET_WINDOWS = 1_000_000
#: Documents in a batch at most, so that two bytes name one of them.
BATCH_DOCS = 65_535
#: Stands for a null id; it comes after all others.
NO_ID = 2**63 - 1

PACKED = "bucket bigint, docs binary, places binary, tops binary, first_top int, low binary"


def _hashes(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Hashes of the windows of each text, in order."""
    found = words(texts)
    every = windows(found.hashes, size)
    return [every[a : max(a, b - size + 1)] for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist())]


def _pack(bucket: int, docs: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> tuple:
    """Sorted hashes in 6 bytes each; the upper 2 bytes are counts per value, from ``first_top`` on.

    Ids are kept as steps, which neighbouring ids make small and alike: the shuffle's compression then removes them.
    """
    tops = (hashes >> np.uint64(48)).astype(np.int64)
    counts = np.bincount(tops - tops[0]).astype("<u4")
    low = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return bucket, np.diff(docs, prepend=0).astype("<i8").tobytes(), places.astype("<u2").tobytes(), counts.tobytes(), int(tops[0]), low.tobytes()


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and their documents' ids."""
    low = np.frombuffer(row["low"], np.uint8).reshape(-1, 6)
    hashes = np.zeros((len(low), 8), np.uint8)
    hashes[:, :6] = low
    counts = np.frombuffer(row["tops"], "<u4")
    tops = np.repeat(np.arange(row["first_top"], row["first_top"] + len(counts)), counts).astype(np.uint64)
    ids = np.cumsum(np.frombuffer(row["docs"], "<i8"))[np.frombuffer(row["places"], "<u2")]
    return hashes.view("<u8")[:, 0] | tops << np.uint64(48), ids


def _groups(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])


def _packed(docs: DataFrame, size: int, n_buckets: int) -> DataFrame:
    """Windows of a batch per bucket; those judged inside the batch under a negative number that no other batch has."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists, held, turn = [], [], 0, TaskContext.get().partitionId() << 32

        def send() -> Iterator[pa.RecordBatch]:
            docs, places = np.unique(np.array(ids, "<i8"), return_inverse=True)
            hashes = np.concatenate(lists)
            places = np.repeat(places, [len(x) for x in lists])
            order = np.lexsort((places, hashes))
            hashes, places = hashes[order], places[order]
            first = _groups(hashes)
            later = places > np.repeat(places[first], np.diff(np.r_[first, len(hashes)]))
            rows = []
            if later.any():  # judged here already; passed on by a bucket
                rows.append(_pack(-1 - turn, docs, hashes[later], places[later]))
            hashes, places = hashes[first], places[first]
            bucket = ((hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
            cuts = np.r_[_groups(bucket), len(bucket)]
            rows += [_pack(int(bucket[a]), docs, hashes[a:b], places[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            kinds = [pa.int64(), *[pa.binary()] * 3, pa.int32(), pa.binary()]
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 64]), kinds)],
                                                 ["bucket", "docs", "places", "tops", "first_top", "low"])

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, found in zip(part.column("id").to_pylist(), _hashes(part.column("text"), size)):
                    if not len(found):
                        continue
                    ids.append(doc)
                    lists.append(found)
                    held += len(found)
                    if held >= BATCH_WINDOWS or len(ids) >= BATCH_DOCS:
                        yield from send()
                        ids.clear()
                        lists.clear()
                        held, turn = 0, turn + 1
        if lists:
            yield from send()

    return docs.select("id", "text").mapInArrow(pack, PACKED)


def _verdicts(docs: DataFrame, size: int, n_buckets: int, parts: int) -> DataFrame:
    """``part, ids, hashes``: packed pairs of a document's id and a window hash that a document before it has."""

    def judge(key: tuple, bucket: pa.Table) -> pa.Table:
        unpacked = [_unpack(row) for row in bucket.to_pylist()]
        hashes, ids = (np.concatenate(x) for x in zip(*unpacked))
        if key[0].as_py() >= 0:
            order = np.argsort(hashes, kind="stable")
            hashes, ids = hashes[order], ids[order]
            first = _groups(hashes)
            least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.r_[first, len(ids)]))
            hashes, ids = hashes[ids > least], ids[ids > least]
        part = np.mod(ids, parts)
        order = np.lexsort((ids, part))
        part, hashes, ids = part[order], hashes[order], ids[order]
        cuts = np.r_[_groups(part), len(part)] if len(part) else np.zeros(1, int)
        pieces = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({"part": pa.array([int(part[p.start]) for p in pieces], pa.int32()),
                         "ids": pa.array([ids[p].astype("<i8").tobytes() for p in pieces], pa.binary()),
                         "hashes": pa.array([hashes[p].astype("<u8").tobytes() for p in pieces], pa.binary())})

    return _packed(docs, size, n_buckets).groupBy("bucket").applyInArrow(judge, "part int, ids binary, hashes binary")


def remove_repeats(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, n_words, n_removed, kept`` for each row: words in all, words removed, and the kept words with one blank between.

    A word is a run of bytes without ASCII blanks. It goes if it lies in a window of ``size`` words that also
    starts in a document with a smaller id; windows are judged on the input. Rows with the same id count as one
    document: they don't remove each other's words. A null id comes after all others. A null or empty text has no
    words; one with fewer than ``size`` keeps them all. An empty table gives no rows; other columns are left out.
    """
    ids = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))
    rows = bounded(docs).select(ids.alias("id"), F.col(text_col).cast("string").alias("text"))
    total = text_bytes(rows)
    parts = n_parts(total)
    verdicts = _verdicts(rows, size, total // 6 // BUCKET_WINDOWS + 1, parts)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        judged = [np.concatenate([np.frombuffer(x, t) for x in right[c].to_pylist()] or [np.zeros(0, t)])
                  for c, t in (("ids", "<i8"), ("hashes", "<u8"))]
        order = np.lexsort((judged[1], judged[0]))
        judged = [x[order] for x in judged]
        out = []
        for batch in left.select(["id", "text"]).combine_chunks().to_batches():
            for part in slices(batch, "text"):
                own = part.column("id").to_numpy()
                low, high = np.searchsorted(judged[0], own, "left"), np.searchsorted(judged[0], own, "right")
                lists = _hashes(part.column("text"), size) if (high > low).any() else None
                for i, text in enumerate(part.column("text").to_pylist()):
                    found = (text or "").encode().split()
                    gone = 0
                    if high[i] > low[i] and len(found) >= size:
                        bad = judged[1][low[i] : high[i]]
                        at = np.minimum(np.searchsorted(bad, lists[i]), len(bad) - 1)
                        starts = np.flatnonzero(bad[at] == lists[i])
                        cover = np.zeros(len(found) + 1, np.int64)
                        np.add.at(cover, starts, 1)
                        np.add.at(cover, starts + size, -1)
                        stay = np.cumsum(cover)[:-1] == 0
                        gone = len(found) - int(stay.sum())
                        kept = [w for w, s in zip(found, stay.tolist()) if s]
                    else:
                        kept = found
                    out.append((int(own[i]), len(found), gone, b" ".join(kept)))
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.table({"id": pa.array(columns[0], pa.int64()), "n_words": pa.array(columns[1], pa.int64()),
                         "n_removed": pa.array(columns[2], pa.int64()), "kept": pa.array(columns[3], pa.binary()).cast(pa.string())})

    texts = rows.withColumn("part", part_of(F.col("id"), parts)).groupBy("part")
    done = texts.cogroup(verdicts.groupBy("part")).applyInArrow(apply, "id bigint, n_words bigint, n_removed bigint, kept string")
    return done.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_words", "n_removed", "kept")
