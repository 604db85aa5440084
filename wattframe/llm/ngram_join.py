"""N-gram Jaccard join by token-combination prefixes, and the groups that its links form.

The tokens of a document are its distinct word shingles. Documents with equal sets form a class; classes are joined:

1. A class with more shingles that no other class has than a link can miss is linked with nothing. Shingles are
   compared by 32 bits inside their bucket, so a chance equality only lets a class through.
2. The shingles of the remaining classes are ordered from rare to frequent. Of a set of ``n`` with ``d`` shingles
   that a partner may miss, a prefix is taken. Rare shingles are indexed one by one and count 1 each. Frequent ones
   are dealt into token classes by their hash and indexed in pairs within each; ``p`` of a class count ``p - 1``.
   The prefix goes on until the count is ``d + 1``: then a partner shares a rare one or a pair.
3. Each index entry ties its classes to one of them, chosen at random per entry; these pairs are verified.
   Entries whose classes are not yet in one component have all their other pairs verified: as pairs in small
   entries, as blocks of classes against blocks in large ones. So a group of thousands of near copies is found
   with few comparisons.

``near_duplicates`` gives groups only: links inside a group that is already joined are neither verified nor returned.
``links`` verifies every pair of classes that share an entry, gives all links and counts them for each row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .batches import bounded, slices
from .components import components
from .parts import with_keys
from .words import mixed, windows, words

#: A shingle that so many classes have, at most, is rare.
RARE = 32
#: Sets from 2 to this power on have token classes; smaller ones index single shingles only.
FIRST_BAND = 5
#: Shingles of a band's smallest set for each token class.
PER_CLASS = 8
#: Entries with more unresolved classes are compared as blocks of ``BLOCK_ROWS`` classes.
SMALL_ENTRY = 16
BLOCK_ROWS = 512
#: Shingles that a task compares at a time in step 1, and numbers it deals to a bucket, about.
BATCH_SHINGLES = 1_000_000
BUCKET_SHINGLES = 1_000_000


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A text with fewer words has one of all its words."""
    found = words(texts, lower=True)
    every, out = windows(found.hashes, size), []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            out.append(mixed(windows(found.hashes[a:b], b - a) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def owner_of(key: bytes) -> int:
    """A class as a number other than 0."""
    return int.from_bytes(key[:8], "little", signed=True) or 1


def _classes(docs: DataFrame, size: int) -> DataFrame:
    """``key, id, n, class, owner``: of each row its key, number of shingles, 128 bits that stand for its set, and 64 of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), size)
                keys = [class_key(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                     pa.array([k and owner_of(k) for k in keys], pa.int64())], ["key", "id", "n", "class", "owner"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("key", "id", "text").mapInArrow(run, f"key bigint, id {kind}, n bigint, class binary, owner bigint")


def _own_shingles(docs: DataFrame, size: int, n_buckets: int) -> DataFrame:
    """``owner, n_own``: for the first 64 bits of a class, how many of its shingles no other class has.

    A task sends every shingle of a batch once: with its class, or without one if several classes of the batch
    have it. A bucket says for each class which of its shingles came from no other.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, sets, owners, seen, held = TaskContext.get().partitionId() << 24, [], [], set(), 0

        def send() -> Iterator[pa.RecordBatch]:
            hashes, at = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            order = np.argsort(hashes, kind="stable")
            hashes, at = hashes[order], at[order]
            first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            alone = np.diff(np.r_[first, len(hashes)]) == 1
            hashes, at = hashes[first], np.where(alone, at[first], -1)
            bucket = ((hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
            order = np.lexsort((at, bucket))
            bucket, at, short = bucket[order], at[order], (hashes[order] & np.uint64(0xFFFFFFFF)).astype("<u4")
            keys = np.array([0, *owners], "<i8")
            cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                runs = np.flatnonzero(np.r_[True, at[a + 1 : b] != at[a : b - 1]])
                rows.append((int(bucket[a]), number, short[a:b].tobytes(), keys[at[a:b][runs] + 1].tobytes(),
                             np.diff(np.r_[runs, b - a]).astype("<u4").tobytes()))
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 256]), kinds)],
                                                 ["bucket", "batch", "short", "owners", "runs"])

        for batch in batches:
            for part in slices(batch, "text"):
                for shingles in shingle_sets(part.column("text"), size):
                    owner = owner_of(class_key(shingles))
                    if len(shingles) and owner not in seen:
                        seen.add(owner)
                        sets.append(shingles)
                        owners.append(owner)
                        held += len(shingles)
                if held >= BATCH_SHINGLES:
                    yield from send()
                    number, held = number + 1, 0
                    sets.clear()
                    owners.clear()
                    seen.clear()
        if sets:
            yield from send()

    def judge(bucket: pa.Table) -> pa.Table:
        rows = [[np.frombuffer(x, t) for x in bucket[c].to_pylist()] for c, t in (("short", "<u4"), ("owners", "<i8"), ("runs", "<u4"))]
        short, owners, runs = (np.concatenate(x) for x in rows)
        order = np.argsort(short, kind="stable")
        each = np.repeat(owners, runs)[order]
        short = short[order]
        first = np.flatnonzero(np.r_[True, short[1:] != short[:-1]])
        least, most = np.minimum.reduceat(each, first), np.maximum.reduceat(each, first)
        own = np.repeat((least == most) & (least != 0), np.diff(np.r_[first, len(short)]))
        flags = np.zeros(len(short), np.int64)
        flags[order] = own
        counts = np.add.reduceat(flags, np.r_[0, np.cumsum(runs)[:-1]].astype(np.int64))
        ends = np.cumsum([len(x) for x in rows[1]])[:-1]
        return pa.table({"batch": bucket["batch"], "owners": pa.array([x.tobytes() for x in rows[1]], pa.binary()),
                         "counts": pa.array([x.astype("<u4").tobytes() for x in np.split(counts, ends)], pa.binary())})

    def add(batch: pa.Table) -> pa.Table:
        owners = np.concatenate([np.frombuffer(x, "<i8") for x in batch["owners"].to_pylist()])
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in batch["counts"].to_pylist()])
        names, at = np.unique(owners, return_inverse=True)
        sums = np.bincount(at, counts, len(names)).astype(np.int64)
        return pa.table({"owner": pa.array(names), "n_own": pa.array(sums)})

    packed = docs.select("text").mapInArrow(pack, "bucket bigint, batch bigint, short binary, owners binary, runs binary")
    judged = packed.groupBy("bucket").applyInArrow(judge, "batch bigint, owners binary, counts binary")
    summed = judged.groupBy("batch").applyInArrow(add, "owner bigint, n_own bigint")
    return summed.groupBy("owner").agg(F.max("n_own").alias("n_own"))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``class, n, shingles`` of the given rows, one for each class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s for s in shingle_sets(part.column("text"), size) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["class", "n", "shingles"])

    return docs.select("text").mapInArrow(run, "class binary, n bigint, shingles binary").dropDuplicates(["class"])


def _bands(n: int, share: tuple[int, int]) -> set[int]:
    """Powers of two from the one at or below the size of a set's smallest possible partner to that of its own size."""
    num, den = share
    return set(range((-(-num * n // den)).bit_length() - 1, n.bit_length()))


def prefix_entries(n: int, counts: np.ndarray, shingles: np.ndarray, share: tuple[int, int]) -> list[int]:
    """Index entries of a set of ``n``, given those of its shingles that other classes have, rare ones first."""
    num, den = share
    need = n - -(-num * n // den) + 1
    entries = []
    for band in _bands(n, share):
        got, seen = n - len(shingles), {}
        n_classes = (1 << band) // PER_CLASS if band >= FIRST_BAND else 0
        for shingle, count in zip(shingles.tolist(), counts.tolist()):
            if got >= need:
                break
            if not n_classes or count <= RARE:
                entries.append((shingle * 0x9FB21C651E98DF25 + band) & 0xFFFFFFFFFFFFFFFF)
                got += 1
                continue
            others = seen.setdefault(shingle % n_classes, [])
            entries += [(x * 0xD6E8FEB86659FD93 ^ shingle * 0xA0761D6478BD642F) + band & 0xFFFFFFFFFFFFFFFF for x in others]
            got += bool(others)
            others.append(shingle)
    return entries


def _index(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``entry, cid, n`` with the entries of each class, each once."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shingles = np.frombuffer(batch.column("shingles")[i].as_py(), "<i8")
                cids = np.full(len(shingles), batch.column("cid")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(shingles), pa.array(cids)], ["shingle", "cid"])

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("found")
            starts, flat = lists.offsets.to_numpy(), lists.values
            counts, shingles = flat.field("count").to_numpy(), flat.field("shingle").to_numpy().view("<u8")
            for i, (cid, n) in enumerate(zip(batch.column("cid").to_pylist(), batch.column("n").to_pylist())):
                part = slice(starts[i], starts[i + 1])
                order = np.lexsort((shingles[part], counts[part]))
                found = np.unique(np.array(prefix_entries(n, counts[part][order], shingles[part][order], share), np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mixed(found).view("<i8")), *(pa.array(np.full(len(found), x, "<i8")) for x in (cid, n))], ["entry", "cid", "n"])

    rows = sets.select("cid", "shingles").mapInArrow(spread, "shingle bigint, cid bigint")
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    found = rows.join(counts, "shingle").groupBy("cid").agg(F.collect_list(F.struct("count", "shingle")).alias("found"))
    return found.join(sets.select("cid", "n"), "cid").select("cid", "n", "found").mapInArrow(entries, "entry bigint, cid bigint, n bigint")


def linked(a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> bool:
    """Whether the common shingles of two sorted sets are the given share of all theirs, or more."""
    num, den = share
    if len(a) > len(b):
        a, b = b, a
    if den * len(a) < num * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _near_size(share: tuple[int, int], n: str = "n", m: str = "m") -> Column:
    return F.least(n, m) * share[1] >= F.greatest(n, m) * share[0]


def _verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` that are links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(c)] for c in ("sa", "sb")]
            keep = [linked(x, y, share) for x, y in zip(*sides)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _block_links(entries: DataFrame, sets: DataFrame, share: tuple[int, int], every: bool = False) -> DataFrame:
    """Links between different components among the classes of large entries ``entry, cid, component``; or all links.

    Classes are put into blocks by their least entry, so that those of a group stand together. Two blocks that
    an entry has in common are compared, every class of one with every class of the other.
    """

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = n + np.arange(batch.num_rows)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("component"), pa.array(np.full(len(places), task)), pa.array(places)],
                ["cid", "component", "task", "place"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.to_pydict(), right.rename_columns(left.column_names).to_pydict()
        sets_a, sets_b = ([np.frombuffer(s, "<u8") for s in x["shingles"]] for x in (a, b))
        out, root = [], {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        if sets_a and sets_b:
            same = a["block"][0] == a["other"][0]
            hashes, owner = np.concatenate(sets_b), np.repeat(np.arange(len(sets_b)), [len(s) for s in sets_b])
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            sizes, (num, den) = np.array([len(s) for s in sets_b]), share
            for i, s in enumerate(sets_a):
                low, high = np.searchsorted(hashes, s, "left"), np.searchsorted(hashes, s, "right")
                n = high - low
                places = np.arange(n.sum()) + np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n)
                both = np.bincount(owner[places], minlength=len(sizes))
                for j in np.flatnonzero(den * both >= num * (len(s) + sizes - both)).tolist():
                    if every:
                        if not same or a["cid"][i] < b["cid"][j]:
                            out.append((a["cid"][i], b["cid"][j]))
                        continue
                    x, y = top(a["component"][i]), top(b["component"][j])
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        out.append((a["cid"][i], b["cid"][j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    places = entries.groupBy("cid", "component").agg(F.min("entry").alias("_least"))
    n_parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = places.repartitionByRange(n_parts, "_least", "cid").sortWithinPartitions("_least", "cid").select("cid", "component")
    numbered = cut_lineage(ordered.mapInArrow(number, "cid bigint, component bigint, task bigint, place bigint"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    sizes = numbered.groupBy("task").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    block = F.floor((F.col("_start") + F.col("place")) / BLOCK_ROWS)
    blocks = cut_lineage(numbered.join(starts, "task").select("cid", "component", block.alias("block")))
    met = entries.join(blocks.select("cid", "block"), "cid").select("entry", "block").distinct()
    cells = met.join(met.withColumnRenamed("block", "other"), "entry").where("block <= other").select("block", "other").distinct()
    full = blocks.join(sets.select("cid", "shingles"), "cid")
    left = cells.join(full, "block").select("block", "other", "cid", "component", "shingles")
    right = cells.join(full.withColumnRenamed("block", "other"), "other")
    right = right.select(*(F.col(c).alias(f"r_{c}") for c in left.columns))  # names of its own, as both have one source
    return left.groupBy("block", "other").cogroup(right.groupBy("r_block", "r_other")).applyInArrow(compare, "a bigint, b bigint")


def _links(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links ``a, b`` between classes, enough of them to join all that are linked directly or by way of others."""
    index = cut_lineage(_index(sets, share))
    # the same class for all entries of a group, so that its pairs with the others are few
    chosen = F.min(F.struct(F.xxhash64("cid").alias("chance"), "cid", "n")).alias("first")
    full = index.groupBy("entry").agg(F.count(F.lit(1)).alias("size"), chosen).where("size > 1")
    tied = index.join(full.select("entry", F.col("first.cid").alias("other"), F.col("first.n").alias("m")), "entry")
    ends = [F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")]
    star = tied.where((F.col("cid") != F.col("other")) & _near_size(share)).select(*ends).distinct()
    first = cut_lineage(_verified(star, sets, share))

    known = components(first).select(F.col("node").alias("cid"), "component")
    rows = index.join(full.select("entry"), "entry").join(known, "cid", "left")
    rows = cut_lineage(rows.withColumn("component", F.coalesce("component", "cid")))
    open_ = rows.groupBy("entry").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("size")).where("_low <> _high")
    rows = cut_lineage(rows.join(open_.select("entry", "size"), "entry"))
    few, many = rows.where(F.col("size") <= SMALL_ENTRY), rows.where(F.col("size") > SMALL_ENTRY)
    others = few.select("entry", F.col("cid").alias("other"), F.col("n").alias("m"), F.col("component").alias("_other"))
    pairs = few.join(others, "entry").where((F.col("cid") < F.col("other")) & (F.col("component") != F.col("_other")) & _near_size(share))
    rest = _verified(pairs.select(*ends).distinct(), sets, share)
    return first.unionByName(rest).unionByName(_block_links(many.select("entry", "cid", "component"), sets, share))


def _every_link(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """All links ``a, b`` between classes, each once, ``a`` below ``b``."""
    index = cut_lineage(_index(sets, share))
    full = index.groupBy("entry").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = cut_lineage(index.join(full, "entry"))
    few, many = rows.where(F.col("size") <= SMALL_ENTRY), rows.where(F.col("size") > SMALL_ENTRY)
    others = few.select("entry", F.col("cid").alias("b"), F.col("n").alias("m"))
    pairs = few.join(others, "entry").where((F.col("cid") < F.col("b")) & _near_size(share))
    found = _verified(pairs.select(F.col("cid").alias("a"), "b").distinct(), sets, share)
    blocks = _block_links(many.select("entry", "cid", F.col("cid").alias("component")), sets, share, every=True)
    return found.unionByName(blocks).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _classes_and_sets(docs: DataFrame, size: int, share: tuple[int, int], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The class of each row, and the sets of the classes that may have links to others."""
    rows = bounded(docs).select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    classes = cut_lineage(_classes(rows, size))
    one = classes.where("n > 0").groupBy("class", "owner").agg(F.min("key").alias("key"), F.max("n").alias("n"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    own = _own_shingles(rows, size, total // BUCKET_SHINGLES + 1)
    num, den = share
    can_miss = F.expr(f"n - (n * {num} + {den - 1}) div {den}")
    kept = one.join(own, "owner", "left").where(F.coalesce("n_own", F.lit(0)) <= can_miss)
    keys = cut_lineage(kept.select("key").distinct())
    texts = with_keys(rows, keys, "left_semi", "key")
    return classes, cut_lineage(_sets(texts, size).withColumn("cid", F.monotonically_increasing_id()))


def links(docs: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id",
          text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: ``row_key, <id>, n_shingles, class, n_links`` for each row, and pairs ``class, other`` of linked classes.

    Sets and links are those of ``near_duplicates``. Rows with equal sets have the same ``class`` and are linked; two
    rows of different classes are linked if the pair of their classes is given, once, the smaller one first.
    ``n_links`` counts the other rows that a row is linked with. A row without shingles has a null class and no link.
    """
    classes, sets = _classes_and_sets(docs, size, share, id_col, text_col)
    found = _every_link(sets, share)
    for side, name in (("a", "_a"), ("b", "_b")):
        found = found.join(sets.select(F.col("cid").alias(side), F.col("class").alias(name)), side)
    pairs = cut_lineage(found.select(F.least("_a", "_b").alias("class"), F.greatest("_a", "_b").alias("other")))
    rows_of = classes.where("class IS NOT NULL").groupBy("class").agg(F.count(F.lit(1)).alias("_rows"))
    both = pairs.unionByName(pairs.select(F.col("other").alias("class"), F.col("class").alias("other")))
    outside = both.join(rows_of.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.sum("_rows").alias("_outside"))
    counts = rows_of.join(outside, "class", "left").select(
        "class", (F.col("_rows") - 1 + F.coalesce("_outside", F.lit(0))).alias("n_links"))
    members = classes.join(counts, "class", "left").select(
        F.col("key").alias("row_key"), F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class",
        F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members, pairs


def near_duplicates(docs: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_key, <id>, n_shingles, component, component_id`` for each row.

    Words are runs of bytes without ASCII blanks, with A-Z in lower case; a set holds the distinct shingles of
    ``size`` words (all words, if fewer). Rows are linked when their sets' intersection is ``share`` (a fraction)
    of their union or more. ``component`` names the group of rows that links join, ``component_id`` is the smallest
    id in it, and ``row_key`` is a hash of id and text, to find the row again. ``links`` gives the links themselves.

    A text that is null or without words has no shingles, is linked with nothing and has a null ``component``.
    Rows with equal sets are linked; repeated rows stay repeated; a row without an id takes part, and a group of
    such rows only has no ``component_id``. An empty table gives no rows; other columns are left out.
    """
    classes, sets = _classes_and_sets(docs, size, share, id_col, text_col)
    found = components(_links(sets, share)).withColumnRenamed("node", "cid")
    named = sets.join(found, "cid").select("class", F.col("component").alias("_c"))
    firsts = named.groupBy("_c").agg(F.min("class").alias("component"))
    named = named.join(firsts, "_c").select("class", "component")
    joined = classes.join(named, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least"))
    return joined.join(least, "component", "left").select(
        F.col("key").alias("row_key"), F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component",
        F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
