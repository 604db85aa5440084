"""Byte-level BPE: texts to token ids and back, with a public vocabulary of ranks."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import bounded, safe_parts, slices

#: Pieces a worker remembers; beyond that it starts anew.
CACHE_PIECES = 400_000
#: Longer pieces are not remembered.
CACHE_CHARS = 64
#: Characters of a text that are split into pieces at a time.
PART_CHARS = 1_000_000


class MinimumTree:
    """Segment tree over positions: the leftmost position of the least rank, and point updates.

    A node has ``2 ** BITS`` children, whose least is found in one call: a piece of a few letters is a root with its leaves.
    """

    NONE = 1 << 62
    BITS = 5

    def __init__(self, ranks: list[int]):
        """``ranks[i]``: rank of the pair that starts at ``i``; NONE for no pair. The list becomes the tree's leaves."""
        level = ranks or [self.NONE]
        self.levels = [level]
        wide = 1 << self.BITS
        while len(level) > wide:
            level = [min(level[k : k + wide]) for k in range(0, len(level), wide)]
            self.levels.append(level)

    def first(self) -> int:
        """Position of the least rank, the leftmost of equals; -1 without any pair."""
        top = self.levels[-1]
        least = min(top)
        if least == self.NONE:
            return -1
        i, bits = top.index(least), self.BITS
        for level in self.levels[-2::-1]:
            i = level.index(least, i << bits)
        return i

    def put(self, i: int, rank: int) -> None:
        bits, below = self.BITS, self.levels[0]
        below[i] = rank
        for level in self.levels[1:]:
            i >>= bits
            least = min(below[i << bits : (i + 1) << bits])
            if level[i] == least:
                break
            level[i] = least
            below = level


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: whole if the vocabulary has it, else merged pair by pair, least rank and leftmost first."""
    rank_of = ranks.get
    whole = rank_of(piece)
    if whole is not None:
        return [whole]
    n, none = len(piece), MinimumTree.NONE
    tree = MinimumTree([rank_of(piece[i : i + 2], none) for i in range(n - 1)])
    first, put = tree.first, tree.put if len(tree.levels) > 1 else tree.levels[0].__setitem__  # leaves below a root need no more
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (i := first()) >= 0:
        j = after[i]
        k = after[j]
        after[i] = k
        if j < n - 1:
            put(j, none)
        if k < n:
            before[k] = i
            put(i, rank_of(piece[i : after[k]], none))
        else:
            put(i, none)
        if (h := before[i]) >= 0:
            put(h, rank_of(piece[h:k], none))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Pieces(dict):
    """Piece -> ids as little-endian unsigned 32-bit integers, filled when asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        found = merge(piece.encode(), self.ranks)
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Coder:
    """One vocabulary with its split pattern; a worker process keeps it between tasks, the pieces only within one."""

    _loaded: dict[tuple[str, str], Coder] = {}

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as file:
            lines = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(self.ranks)

    @classmethod
    def of(cls, path: str, pattern: str) -> Coder:
        if (path, pattern) not in cls._loaded:
            cls._loaded[path, pattern] = cls(path, pattern)
        return cls._loaded[path, pattern]

    def encode(self, text: str) -> bytes:
        ids = self.pieces.__getitem__
        return b"".join(b"".join(map(ids, self.split(part))) for part in safe_parts(text, PART_CHARS))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for each row: the text's token ids, packed as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded by itself; strings that look like special tokens are ordinary text. Rows
    stay where they are: there is no shuffle. ``path`` names a file of base64 tokens and ranks that every worker
    can read. A null or empty text has no ids; repeated rows stay repeated; other columns are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [coder.encode(t) if t else b"" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])
        coder.pieces.clear()  # the worker goes on to other tasks

    kind = docs.schema[id_col].dataType.simpleString()
    rows = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, data``: the bytes that packed ids stand for. A null counts as no ids; an unknown id is an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern)
        for batch in batches:
            for part in slices(batch, "ids"):
                data = [coder.decode(x) if x else b"" for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("ids"), pa.array(data, pa.binary())], ["id", "ids", "data"])

    kind = rows.schema[id_col].dataType.simpleString()
    rows = bounded(rows).select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, ids binary, data binary").withColumnRenamed("id", id_col)
