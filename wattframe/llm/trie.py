"""The prefix trie of conversations: double-array tries per run of sorted prefixes, shared upper nodes merged."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .batches import bounded
from .common import WORD, word_count
from .parts import with_keys

#: Turns that one trie is deep; longer conversations go on in tries of their own.
LEVEL = 1_024
#: Sequences and turns of one trie.
CHUNK_ROWS, CHUNK_TURNS = 4_096, 200_000
#: Cells of a double array that are tried at a time.
SPAN = 1_024
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_NO_ID = 2**63 - 1
_KEY = 16  # bytes of a turn's digest


# ---- the double array ----


class DoubleArray:
    """A trie over dense turn ids: node ``s`` has the child ``t = base[s] + id`` if ``check[t] == s``. Node 0 is the root."""

    def __init__(self, n_ids: int):
        self.n_ids = n_ids
        self.base = np.zeros(1, np.int64)
        self.check = np.full(1, -2, np.int64)
        self.depth = np.full(1, -1, np.int64)
        self._free = 1
        self._roomy = 1  # before it, siblings are not looked for: hardly a cell is free

    def _grow(self, size: int) -> None:
        more = max(size, 2 * len(self.check)) - len(self.check)
        if size > len(self.check):
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
            self.depth = np.concatenate([self.depth, np.full(more, -1, np.int64)])

    def _place(self, ids: np.ndarray) -> int:
        """The first base with room for all children; all cells behind the array are free.

        Cells are tried ``SPAN`` at a time. So the array ends where one more family doesn't fit before it: it grows
        by what its nodes take, also when siblings have consecutive ids and leave few gaps.
        """
        away, start = ids - ids[0], max(self._free, self._roomy)
        while start < len(self.check):
            room = np.ones(SPAN, bool)
            for i, d in enumerate(away.tolist()):
                cells = self.check[start + d : start + d + SPAN] == -1
                room[: len(cells)] &= cells
                if not i and start == self._roomy and np.count_nonzero(room) < SPAN // 16:
                    self._roomy += SPAN
                if i % 16 == 0 and not room.any():
                    break
            if room.any():
                return int(start + room.argmax() - ids[0])
            start += SPAN
        return int(start - ids[0])

    def add_children(self, parents: np.ndarray, ids: np.ndarray, depth: int) -> None:
        """Give each parent its children; pairs come sorted and once."""
        nodes, first, number = np.unique(parents, return_index=True, return_counts=True)
        for k in np.flatnonzero(number > 1):
            own = ids[first[k] : first[k] + number[k]]
            self.base[nodes[k]] = base = self._place(own)
            self._grow(int(base + own[-1] + 1))
            self.check[base + own], self.depth[base + own] = nodes[k], depth
        one = number == 1
        self._grow(len(self.check) + int(one.sum() - (self.check[self._free :] == -1).sum()))
        free = np.flatnonzero(self.check[self._free :] == -1)[: one.sum()] + self._free
        self.base[nodes[one]] = free - ids[first[one]]
        self.check[free], self.depth[free] = nodes[one], depth
        taken = np.flatnonzero(self.check[self._free :] == -1)
        self._free += int(taken[0]) if len(taken) else len(self.check) - self._free

    def step(self, nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Children of the nodes, -1 where there is none."""
        to = self.base[nodes] + ids
        inside = (to >= 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == nodes), to, -1)


def pack(ids: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """The trie of sequences ``ids[first:first + length]``, and the node of every element."""
    trie = DoubleArray(int(ids.max()) + 1 if len(ids) else 1)
    node_of = np.zeros(len(ids), np.int64)
    now = np.zeros(len(first), np.int64)
    for depth in range(int(lengths.max()) if len(lengths) else 0):
        alive = np.flatnonzero(lengths > depth)
        own = ids[first[alive] + depth]
        pairs = np.unique(now[alive] * trie.n_ids + own)
        trie.add_children(pairs // trie.n_ids, pairs % trie.n_ids, depth)
        now[alive] = trie.step(now[alive], own)
        node_of[first[alive] + depth] = now[alive]
    return trie, node_of


# ---- one trie ----

_PART = pa.struct([("n", pa.int64()), ("conv_id", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()),
                   ("saved", pa.int64()), ("ends", pa.string())])
_OUT = pa.schema([
    ("path", pa.binary()), ("words", pa.list_(pa.int64())), ("parts", pa.list_(_PART)),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.binary()), ("key", pa.binary()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends_sha256", pa.string()), ("said", pa.binary()),
])
_OUT_DDL = ("path binary, words array<bigint>, parts array<struct<n bigint, conv_id bigint, kids bigint, leaves bigint, saved bigint, "
            "ends string>>, conv_id bigint, depth bigint, parent_conv_id bigint, parent_key binary, key binary, n_convs bigint, "
            "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, said binary")


def _nodes(rows: list[tuple], whole: bool, depth: int) -> Iterator[pa.RecordBatch]:
    """The nodes of the trie of sorted sequences ``(path, words, parts, again)``; each part is what is known of one node.

    A node on the way to the first or the last sequence may have more sequences in the tries beside this one. Unless
    this is the ``whole`` table, these two sequences go out again, with what was found for each of their nodes.
    """
    paths, words, parts, again = zip(*rows)
    lengths = np.array([len(p) // _KEY for p in paths])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    _, ids = np.unique(np.frombuffer(b"".join(paths), f"S{_KEY}"), return_inverse=True)
    trie, node_of = pack(ids.astype(np.int64), first, lengths)

    size = len(trie.check)
    flat = [p for own in parts for p in own]
    column = lambda name: np.fromiter((p[name] for p in flat), np.int64, len(flat))
    n, kids, leaves, saved = (np.zeros(size, np.int64) for _ in range(4))
    for total, name in ((n, "n"), (kids, "kids"), (leaves, "leaves"), (saved, "saved")):
        np.add.at(total, node_of, column(name))
    least = np.full(size, _NO_ID, np.int64)
    np.minimum.at(least, node_of, column("conv_id"))
    cost = np.zeros(size, np.int64)
    cost[node_of] = np.fromiter((w for own in words for w in own), np.int64, len(flat))
    where = np.zeros(size, np.int64)
    where[node_of] = np.repeat(np.arange(len(rows)), lengths)
    ends = {int(node): p["ends"] for node, p in zip(node_of, flat) if p["ends"] is not None}

    border = np.zeros(size, bool)
    edges = [] if whole else sorted({0, len(rows) - 1})
    for k in edges:
        border[node_of[first[k] : first[k] + lengths[k]]] = True
    nodes = np.flatnonzero(trie.check >= 0)
    nodes = nodes[np.argsort(trie.depth[nodes], kind="stable")]
    done = nodes[~border[nodes]]
    cuts = np.searchsorted(trie.depth[done], np.arange(lengths.max() + 1))
    for a, b in reversed(list(zip(cuts, cuts[1:]))):
        level = done[a:b]
        leaves[level] = np.where(kids[level] == 0, 1, leaves[level])
        saved[level] += (n[level] - 1) * cost[level]
        above = trie.check[level]
        np.add.at(kids, above, 1)
        np.add.at(leaves, above, leaves[level])
        np.add.at(saved, above, saved[level])

    prefix = lambda node: paths[where[node]][: _KEY * (int(trie.depth[node]) + 1)]
    met_before = set(node_of[np.repeat(again, lengths)].tolist())  # nodes whose children may be out already
    out = []
    for node in done.tolist():
        above, at = int(trie.check[node]), int(trie.depth[node])
        open_ = at > 0 and border[above]
        out.append((
            None, None, None, int(least[node]), depth + at, int(least[above]) if at > 0 and not open_ else None,
            hashlib.md5(prefix(above)).digest() if open_ else None,
            hashlib.md5(prefix(node)).digest() if node in met_before else None,
            int(n[node]), int(kids[node]), int(leaves[node]), int(saved[node]), ends.get(node), prefix(node)[-_KEY:],
        ))
    sent: set[int] = set()
    for k in edges:
        own = node_of[first[k] : first[k] + lengths[k]].tolist()
        found = [
            {"n": 0, "conv_id": _NO_ID, "kids": 0, "leaves": 0, "saved": 0, "ends": None} if node in sent else
            {"n": int(n[node]), "conv_id": int(least[node]), "kids": int(kids[node]), "leaves": int(leaves[node]),
             "saved": int(saved[node]), "ends": ends.get(node)} for node in own]
        sent.update(own)
        out.append((paths[k], list(words[k]), found, *([None] * 11)))
    for a in range(0, len(out), 10_000):
        columns = zip(*out[a : a + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)


def _tries(batches, whole: bool, depth: int):
    """Tries of runs of a sorted partition."""
    rows, turns = [], 0
    for batch in batches:
        table = batch.to_pydict()
        for i in range(batch.num_rows):
            path, parts = table["path"][i], table["parts"][i]
            size = len(path) // _KEY
            if parts is None:
                one = {"n": table["n"][i], "conv_id": table["conv_id"][i], "kids": 0, "leaves": 0, "saved": 0, "ends": None}
                last = {**one, "kids": table["kids"][i], "leaves": table["leaves"][i], "saved": table["saved"][i], "ends": table["ends"][i]}
                row = (path, table["words"][i], [one] * (size - 1) + [last], False)
            else:
                row = (path, table["words"][i], parts, True)
            if rows and not whole and (len(rows) >= CHUNK_ROWS or turns + size > CHUNK_TURNS):
                yield from _nodes(rows, whole, depth)
                rows, turns = [], 0
            rows.append(row)
            turns += size
    if rows:
        yield from _nodes(rows, whole, depth)


# ---- on Spark ----


def _ranked(batches):
    """Each row's place among its conversation's rows in this partition, which is sorted."""
    from pyspark import TaskContext

    part, now, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(conv)) + 1])
        rank = np.arange(1, len(conv) + 1) - np.repeat(starts, np.diff([*starts, len(conv)]))
        if conv[0] == now:
            rank[: starts[1] if len(starts) > 1 else len(conv)] += count
        now, count = conv[-1], int(rank[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(len(conv), part, np.int32)), pa.array(rank)],
            names=["conv_id", "said", "words", "part", "rank"])


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, place, said, words`` of each turn, and ``conv_id, n_turns``.

    Places count from 1 by turn, nulls first, ties by the digest ``said`` of role and text. All rows are sorted by
    range, so that a long conversation lies in several tasks; the places in a task go on from those before it.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), said.alias("said"),
        word_count(text).alias("words"))
    rows = rows.repartitionByRange("conv_id", "turn", "said").sortWithinPartitions("conv_id", "turn", "said")
    rows = cut_lineage(rows.select("conv_id", "said", "words").mapInArrow(
        _ranked, "conv_id bigint, said string, words bigint, part int, rank bigint"))
    runs = rows.groupBy("conv_id", "part").agg(F.max("rank").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut_lineage(runs.select("conv_id", "part", "n", F.sum("n").over(before).alias("before")))
    # only a partition's first conversation can have begun before it: one row for each partition at most
    later = F.broadcast(runs.where("before IS NOT NULL").select("conv_id", "part", "before"))
    rows = rows.join(later, ["conv_id", "part"], "left")
    rows = rows.select("conv_id", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("place"), "said", "words")
    return rows, runs.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their ``every``: ``conv_id, depth, said, words`` and ``conv_id, n_turns``.

    Conversation ``c`` takes the first ``h`` turns of ``c - c % every``, as many as there are, then its own after its
    first ``h``; ``h`` is the CRC-32 of ``c`` in decimals modulo ``most + 1``.
    """
    rows, convs = numbered(conversations)
    taken = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % (most + 1)).alias("_taken")
    convs = convs.select("conv_id", "n_turns", taken, (F.col("conv_id") - F.col("conv_id") % every).alias("_from"))
    lengths = convs.select(F.col("conv_id").alias("_from"), F.col("n_turns").alias("_there"))
    convs = convs.join(lengths, "_from", "left")
    used = F.least("_taken", F.coalesce("_there", F.lit(0)))
    convs = cut_lineage(convs.select("conv_id", "_from", "_taken", used.alias("_used"),
                                     (used + F.greatest(F.col("n_turns") - F.col("_taken"), F.lit(0))).alias("n_turns")))
    heads = rows.where(F.col("place") <= most).withColumnRenamed("conv_id", "_from")
    heads = convs.where("_used > 0").join(heads, "_from").where("place <= _used")
    own = rows.join(convs.select("conv_id", "_taken", "_used"), "conv_id").where("place > _taken")
    turns = heads.select("conv_id", F.col("place").alias("depth"), "said", "words").unionByName(
        own.select("conv_id", (F.col("place") - F.col("_taken") + F.col("_used")).alias("depth"), "said", "words"))
    return turns, convs.select("conv_id", "n_turns")


def _end_hashes(batches):
    """SHA-256 of the ids of each end, one after the other, from rows sorted by end and id."""
    now, sha = None, None
    ends, hashes = [], []
    for batch in batches:
        for end, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if end != now:
                if now is not None:
                    ends.append(now)
                    hashes.append(sha.hexdigest())
                now, sha = end, hashlib.sha256(str(conv).encode())
            else:
                sha.update(f",{conv}".encode())
        if len(ends) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(ends, pa.string()), pa.array(hashes, pa.string())], names=["end", "ends"])
            ends, hashes = [], []
    if now is not None:
        ends.append(now)
        hashes.append(sha.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(ends, pa.string()), pa.array(hashes, pa.string())], names=["end", "ends"])


def _sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, level, path, words, last, next``: conversations in pieces of ``LEVEL`` turns.

    ``path`` is the key of all turns before the piece, then a digest for each turn of it; ``next`` is the key of the
    next piece. A conversation that ends with a full piece has an empty one after it, so that every node at the end
    of a piece is the root of the next level's trie.
    """
    marks = convs.select("conv_id", (F.col("n_turns") + 1).alias("depth"), F.lit(None).cast("string").alias("said"),
                         F.lit(0).cast("bigint").alias("words"))
    rows = turns.unionByName(marks).withColumn("level", F.expr(f"CAST((depth - 1) div {LEVEL} AS INT)"))
    turn = F.when(F.col("said").isNotNull(), F.struct("depth", "said", "words"))
    rows = rows.groupBy("conv_id", "level").agg(F.array_sort(F.collect_list(turn)).alias("_turns"),
                                                F.max(F.col("said").isNull()).alias("last"))
    rows = rows.select("conv_id", "level", "last", F.unhex(F.array_join("_turns.said", "")).alias("_piece"),
                       F.concat(F.array(F.lit(0).cast("bigint")), F.col("_turns.words")).alias("words"))
    before = Window.partitionBy("conv_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)

    def key(upto: Column, own: Column, *seed: Column) -> tuple[Column, Column]:
        start = F.coalesce(F.bit_xor(own).over(upto), F.lit(0).cast("bigint"))
        return start, start.bitwiseXOR(own)

    half = [key(before, F.xxhash64("level", "_piece", F.lit(seed))) for seed in (1, 2)]
    as_bytes = lambda halves: F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves)))
    rows = rows.select("*", as_bytes([a for a, _ in half]).alias("_key"), as_bytes([b for _, b in half]).alias("_next"))
    return rows.select("conv_id", "level", "last", F.concat("_key", "_piece").alias("path"), "words",
                       F.when(~F.col("last"), F.col("_next")).alias("next"))


def _level(rows: DataFrame, depth: int) -> list[DataFrame]:
    """All nodes of the sequences of one level: tries of sorted runs, then a trie of their shared upper nodes, and so on."""
    spark, found = rows.sparkSession, []
    while True:
        size = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.expr(f"octet_length(path) div {_KEY}")).alias("turns")).first()
        whole = size.rows <= CHUNK_ROWS and (size.turns or 0) <= CHUNK_TURNS
        n = max(size.rows // CHUNK_ROWS, (size.turns or 0) // CHUNK_TURNS) + 1
        n = 1 if whole else min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
        placed = (rows.repartition(1) if whole else rows.repartitionByRange(n, "path")).sortWithinPartitions("path")
        made = cut_lineage(bounded(placed).mapInArrow(functools.partial(_tries, whole=whole, depth=depth), _OUT_DDL))
        found.append(made.where("depth IS NOT NULL"))
        if whole:
            return found
        rows = made.where("depth IS NULL").select("path", "words", "parts", *_plain())


def _plain() -> list[Column]:
    return [F.lit(None).cast("bigint").alias(c) for c in ("n", "conv_id", "kids", "leaves", "saved")] + [
        F.lit(None).cast("string").alias("ends")]


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct beginning of conversations, the empty one included.

    ``turns`` has ``conv_id, depth, said, words`` with depths from 1 without gaps, ``convs`` every ``conv_id`` once with
    its ``n_turns``, none being allowed. ``said`` is a turn's digest in 32 hex digits; equal digests are equal turns.
    Columns: ``conv_id`` (the smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, said``. An empty table has no nodes.

    Conversations that are alike are one sequence with a number. Sequences are sorted by range over their turns, and
    each run of ``CHUNK_ROWS`` (or ``CHUNK_TURNS``) becomes a double array. Only nodes on the way to a run's first and
    last sequence can be shared with other runs; these two sequences go on, with what is known of their nodes, to a
    trie of their own, which is cut into runs again while it is large. So neither a first turn that a third of
    all conversations share nor copies of one conversation meet in a task, only the ids that end at one node do,
    as a stream, because their hash needs them in order. Conversations of more than ``LEVEL`` turns go on in further
    levels, the last of which is built first; there are as many rounds as the longest conversation has levels.
    """
    pieces = cut_lineage(_sequences(turns, convs))
    ends = pieces.where("last").select(F.md5("path").alias("end"), "conv_id")
    ends = ends.repartition("end").sortWithinPartitions("end", "conv_id").mapInArrow(_end_hashes, "end string, ends string")
    ends = cut_lineage(ends)
    deepest = pieces.agg(F.max("level")).first()[0]
    found, keyed, roots = [], [], None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        rows = pieces.where(F.col("level") == level).groupBy("path", "words", "next").agg(
            F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
        rows = rows.withColumn("end", F.md5("path")).join(ends, "end", "left").drop("end")
        none = F.lit(0).cast("bigint")
        if roots is None:
            rows = rows.select("path", "words", "n", "conv_id", none.alias("kids"), none.alias("leaves"), none.alias("saved"), "ends")
        else:
            below = roots.select(F.col("said").alias("next"), F.col("n_children").alias("kids"), F.col("saved_tokens").alias("saved"),
                                 F.when(F.col("n_children") > 0, F.col("n_leaves")).alias("leaves"), F.col("ends_sha256").alias("_ends"))
            rows = rows.join(below, "next", "left").select("path", "words", "n", "conv_id", *(
                F.coalesce(c, none).alias(c) for c in ("kids", "leaves", "saved")), F.coalesce("ends", "_ends").alias("ends"))
        rows = cut_lineage(rows.withColumn("parts", F.lit(None).cast(
            "array<struct<n bigint, conv_id bigint, kids bigint, leaves bigint, saved bigint, ends string>>")))
        nodes = _level(rows, level * LEVEL)
        roots = functools.reduce(DataFrame.unionByName, (f.where(F.col("depth") == level * LEVEL) for f in nodes))
        keyed += nodes
        found += [f.where(F.col("depth") > level * LEVEL) if level else f for f in nodes]
    if not found:
        return turns.sparkSession.createDataFrame([], (
            "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
            "saved_tokens bigint, ends_sha256 string, said binary"))
    all_ = functools.reduce(DataFrame.unionByName, found)
    parents = functools.reduce(DataFrame.unionByName, keyed).where("key IS NOT NULL")
    parents = cut_lineage(parents.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent")))
    lost = with_keys(all_.where("parent_key IS NOT NULL"), parents, "inner", key="parent_key")
    columns = ("n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"), "said")
    return all_.where("parent_key IS NULL").select("conv_id", "depth", "parent_conv_id", *columns).unionByName(
        lost.select("conv_id", "depth", F.col("_parent").alias("parent_conv_id"), *columns))
