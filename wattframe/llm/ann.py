"""Approximate nearest neighbours by cross-polytope hashing with several probes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .vectors import first_of_equals, matrix, one_per_id, ranked

#: Tables, and buckets that a query looks at in each while a table has one hash. Recall rises with both, and so does the work.
TABLES = 16
PROBES = 8
#: Candidates of a bucket that further hashes aim at, about.
BUCKET_ROWS = 16
#: Candidates, and queries, that a task compares at a time.
CELL_ROWS = 4_096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two. Steps run along the rows' places in memory."""
    n, width = x.shape
    x, step = np.ascontiguousarray(x.T), 1
    while step < width:
        x, old = np.empty((width // (2 * step), 2, step, n)), x.reshape(width // (2 * step), 2, step, n)
        np.add(old[:, 0], old[:, 1], out=x[:, 0])
        np.subtract(old[:, 0], old[:, 1], out=x[:, 1])
        step *= 2
    return (x.reshape(width, n) / np.sqrt(width)).T


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Pseudo-rotation of a table: three rounds of random signs and a Hadamard transform."""
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def hash_widths(n: int, width: int) -> list[int]:
    """Coordinates of each hash of a table for ``n`` candidates: a full one, and more until buckets are small enough.

    A hash of ``w`` coordinates has ``2 * w`` signed axes. All but the last have ``width``; the last has as many as
    are needed, so that the number of buckets follows the table's size by powers of two.
    """
    out, left = [width], n / (2 * width * BUCKET_ROWS)
    while left >= 2:
        out.append(min(width, 1 << int(np.log2(left)) - 1))
        left /= 2 * out[-1]
    return out


def n_probes(widths: list[int], probes: int) -> int:
    """Buckets that a query looks at in a table: more by the root of the number of buckets that further hashes make."""
    return int(np.ceil(probes * np.sqrt(np.prod([2.0 * w for w in widths[1:]]))))


def codes(unit: np.ndarray, table: int, widths: list[int], n: int, seed: int) -> np.ndarray:
    """The ``n`` buckets of a table that suit each row best, best first, at most all there are.

    A hash costs a bucket the square of what its signed axis falls short of the nearest one; costs add up over
    the hashes, and the ``n`` best of all are among the ``n`` best of the hashes before, each with every axis.
    """
    costs, found = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
    for i, w in enumerate(widths):
        x = rotated(unit, table if not i else i * 1_000_003 + table, seed)[:, :w]
        if n == 1:  # nothing to weigh
            axis = np.abs(x).argmax(1)[:, None]
            found = found * (2 * w) + 2 * axis + (np.take_along_axis(x, axis, 1) > 0)
            continue
        x = np.stack((-x, x), axis=2).reshape(len(x), 2 * w)  # axis ``2 * i``, and ``2 * i + 1`` for its positive side
        near = np.argsort(-x, axis=1, kind="stable")[:, :n]
        x = np.take_along_axis(x, near, 1)
        costs = (costs[:, :, None] + ((x[:, :1] - x) ** 2)[:, None, :]).reshape(len(x), -1)
        found = (found[:, :, None] * (2 * w) + near[:, None, :]).reshape(len(x), -1)
        order = np.argsort(costs, axis=1, kind="stable")[:, :n]
        costs, found = np.take_along_axis(costs, order, 1), np.take_along_axis(found, order, 1)
    return found


def _hashed(rows: DataFrame, dim: int, tables: int, widths: list[int], probes: int, seed: int, number: str) -> DataFrame:
    """``key, low, id, data``: a row for each group of buckets that a vector has buckets in.

    Buckets that differ in the last bits of their code only are a group; ``low`` has those bits, a byte for each
    of the vector's buckets in the group. Components are packed as they came, 4 or 8 bytes each.
    """
    width = widths[0]
    shift = low_bits(widths)
    groups = int(np.prod([2 * w for w in widths], dtype=object)) >> shift

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CELL_ROWS):
                part = batch.slice(start, CELL_ROWS)
                data = matrix(part.column("vector"), dim)
                unit = np.zeros((len(data), width))
                largest = np.abs(data).max(1, keepdims=True)
                unit[:, :dim] = data / largest  # so that no square is out of range
                unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
                packed = pa.array([row.tobytes() for row in np.ascontiguousarray(data, number)], pa.binary())
                step = max(1, 4_000_000 // (probes * 2 * max(widths)))  # rows whose buckets are weighed at a time
                for table in range(tables):
                    for at in range(0, len(unit), step):
                        found = np.sort(codes(unit[at : at + step], table, widths, probes, seed), axis=1)
                        group = found >> shift
                        new = np.ones(found.shape, bool)
                        new[:, 1:] = group[:, 1:] != group[:, :-1]
                        owner, _ = np.nonzero(new)
                        owner += at
                        ends = np.r_[np.flatnonzero(new), new.size].astype("<i4")
                        lows = (found & (1 << shift) - 1).astype(np.uint8)
                        low = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(ends), pa.py_buffer(lows.tobytes())])
                        for i in range(0, len(owner), CELL_ROWS):
                            some = pa.array(owner[i : i + CELL_ROWS])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(group[new][i : i + CELL_ROWS] + table * groups, pa.int64()), low.slice(i, CELL_ROWS),
                                 part.column("id").take(some), packed.take(some)], ["key", "low", "id", "data"])

    return rows.select("id", "vector").mapInArrow(run, "key bigint, low binary, id bigint, data binary")


def low_bits(widths: list[int]) -> int:
    """Bits of a bucket's code that don't part tasks: buckets are grouped up to about ``CELL_ROWS`` candidates, 256 at most."""
    further = sum(int(2 * w).bit_length() - 1 for w in widths[1:])
    return max(0, min(further, int(np.log2(max(1, CELL_ROWS // BUCKET_ROWS))), 8))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; the same for the same pair wherever it stands."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _in_range(m: np.ndarray) -> np.ndarray:
    """Rows whose sum of squares is neither lost nor out of range."""
    with np.errstate(over="ignore", under="ignore"):
        squares = (m * m).sum(1)
    return np.isfinite(squares) & (squares > 1e-280)


def nearest(
    queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vector",
    tables: int = TABLES, probes: int = PROBES, seed: int = 7,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest candidates of other ids that the tables find, by cosine.

    A table rotates unit vectors and files each under its nearest signed axis; in a larger table several rotations
    are joined, so that a bucket keeps about ``BUCKET_ROWS`` candidates, and a query looks into its nearest buckets,
    ``probes`` times the root of what further hashes multiply them by. So the candidates of a query grow with the
    root of the table. What it meets is compared exactly, on the original vectors in double precision; ties go to
    the smaller id. Every candidate is indexed in every table. A full group of buckets is cut into cells of about
    ``CELL_ROWS`` candidates and queries, and all cells are searched; equal vectors are indexed ``k + 1`` times at
    most, which loses nothing (see ``first_of_equals``).

    Null and zero vectors and those with a null or not finite component take no part, nor rows without an id.
    Rows that share an id count as one (see ``one_per_id``); shorter vectors are filled with zeros. An empty table
    gives no rows; other columns are left out.
    """
    kinds = {df.schema[vector_col].dataType.simpleString() for df in (queries, candidates)}
    number = "<f4" if kinds == {"array<float>"} else "<f8"
    nonzero = F.exists("vector", lambda x: x != 0)
    queries = one_per_id(queries, id_col, vector_col).where(nonzero)
    candidates = one_per_id(candidates, id_col, vector_col).where(nonzero)
    sizes = [df.agg(F.max(F.size("vector")), F.count(F.lit(1))).first() for df in (queries, candidates)]
    dim = max(*(size or 0 for size, _ in sizes), 1)
    widths = hash_widths(sizes[1][1], 1 << max(0, dim - 1).bit_length())
    # written once: rows are hashed twice, for the sizes of the buckets and to be sent, and the plan has its steps before once
    kept = [cut_lineage(df.withColumn("vector", F.col("vector").cast("array<float>" if number == "<f4" else "array<double>")))
            for df in (first_of_equals(candidates, k + 1), queries)]
    filed = _hashed(kept[0], dim, tables, widths, 1, seed, number)
    asked = _hashed(kept[1], dim, tables, widths, n_probes(widths, probes), seed, number)
    counted = lambda df, c, q: df.select("key", F.lit(c).alias("c"), F.lit(q).alias("q"))
    counts = counted(filed, 1, 0).unionAll(counted(asked, 0, 1)).groupBy("key").agg(F.sum("c").alias("c"), F.sum("q").alias("q"))
    cells = lambda n: F.floor(F.col(n) / CELL_ROWS) + 1
    cut = counts.where("c > 0 AND q > 0").select("key", cells("c").alias("c_cells"), cells("q").alias("q_cells"))  # one row per group of buckets

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        """A row falls into one of the bucket's cells of its own kind, and meets all cells of the other.

        The planner takes hashed rows for about as small as the vectors they come from and would broadcast far more
        than its limit; the hint has the groups, which are few, looked up by key instead.
        """
        place = F.pmod(F.xxhash64("id"), F.col(f"{own}_cells")).alias(own)
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}_cells") - 1)).alias(other)
        return df.join(cut.hint("shuffle_hash"), "key").select("key", place, every, "low", "id", "data")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.Table.from_pydict({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        ids, q_ids = left["id"].to_numpy(), right["id"].to_numpy()
        c = np.frombuffer(b"".join(left["data"].to_pylist()), number).reshape(len(ids), -1).astype("f8")
        q = np.frombuffer(b"".join(right["data"].to_pylist()), number).reshape(len(q_ids), -1).astype("f8")
        scale = lambda m: (u := m / np.abs(m).max(1, keepdims=True)) / np.sqrt((u * u).sum(1, keepdims=True))
        c_unit, q_unit = scale(c), scale(q)
        lows = np.frombuffer(b"".join(left["low"].to_pylist()), np.uint8)
        order = np.argsort(lows, kind="stable")
        starts = np.searchsorted(lows[order], np.arange(257))
        asked_for = [np.frombuffer(x, np.uint8) for x in right["low"].to_pylist()]
        owner, wanted = np.repeat(np.arange(len(q_ids)), [len(x) for x in asked_for]), np.concatenate(asked_for)
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for low in np.unique(wanted).tolist():
            some, every = order[starts[low] : starts[low + 1]], owner[wanted == low]
            for start in range(0, len(every) if len(some) else 0, 512):
                part = every[start : start + 512]
                rough = q_unit[part] @ c_unit[some].T
                rough[q_ids[part][:, None] == ids[some][None, :]] = -np.inf
                n = len(some) - min(k, len(some))
                i, j = np.nonzero(rough >= np.maximum(np.partition(rough, n, axis=1)[:, n], -2.0)[:, None] - 1e-9)
                pairs.append((part[i], some[j]))
        a, b = (np.concatenate(x) for x in zip(*pairs))
        plain, scores = _in_range(q)[a] & _in_range(c)[b], np.zeros(len(a))
        for start in range(0, len(a), 65_536):
            at = slice(start, start + 65_536)
            x = np.where(plain[at][:, None], q[a[at]], q_unit[a[at]])
            scores[at] = _cosines(x, np.where(plain[at][:, None], c[b[at]], c_unit[b[at]]))
        top = np.lexsort((ids[b], -scores, a))
        place = np.arange(len(top)) - np.searchsorted(a[top], a[top])
        top = top[place < k]
        return pa.table({"query_id": pa.array(q_ids[a[top]]), "vec_id": pa.array(ids[b[top]]), "score": pa.array(scores[top])})

    met = spread(filed, "c", "q").groupBy("key", "c", "q").cogroup(spread(asked, "q", "c").groupBy("key", "c", "q"))
    found = met.applyInArrow(compare, "query_id bigint, vec_id bigint, score double")
    return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)
