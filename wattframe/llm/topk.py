"""Exact search for the largest inner products, in buckets of similar length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .batches import bounded
from .vectors import first_of_equals, matrix, one_per_id, ranked

#: Vectors in a group (what a task gets at once) and in a bucket (what shares a length bound).
GROUP_ROWS = 8_192
BUCKET_ROWS = 1_024
QUERY_ROWS = 512
#: Bytes of groups that a task holds while blocks of queries pass by, about.
HOLD_BYTES = 64_000_000
#: Local cosine thresholds from here on are worth looking at single coordinates.
COORDINATES_FROM = 0.75
#: Coordinates looked at, the query's largest.
FOCUS = 3
#: Below this, sums of products of whole numbers are exact in a double.
EXACT = 2.0**53
SLACK = 1e-9

BLOCK = "block bigint, longest double, n int, ids binary, lengths binary, number string, data binary"


def _number(data: np.ndarray) -> str:
    """The shortest kind of number that holds whole numbers as large as these."""
    most = np.abs(data).max(initial=0)
    return next((kind for kind in ("<i1", "<i2", "<i4") if most <= np.iinfo(kind).max), "<f8")


def _blocks(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """Rows ordered by falling length, packed ``size`` to a row. Equal lengths are split by id like any others."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, have = TaskContext.get().partitionId() << 24, [], 0

        def block(tables: list[pa.Table]) -> pa.RecordBatch:
            nonlocal number
            rows = pa.concat_tables(tables)
            ids, data = rows["id"].to_numpy().astype("<i8"), matrix(rows["vector"], dim)
            lengths = np.sqrt((data * data).sum(1))
            order = np.argsort(-lengths, kind="stable")
            number += 1
            kind = _number(data)
            values = [[number - 1], [float(lengths.max())], [len(ids)], [ids[order].tobytes()],
                      [lengths[order].astype("<f8").tobytes()], [kind], [data[order].astype(kind).tobytes()]]
            kinds = [pa.int64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)],
                                              ["block", "longest", "n", "ids", "lengths", "number", "data"])

        for batch in batches:
            rest = pa.Table.from_batches([batch])
            while rest.num_rows:
                part = rest.slice(0, size - have)
                held.append(part)
                have, rest = have + part.num_rows, rest.slice(part.num_rows)
                if have == size:
                    yield block(held)
                    held, have = [], 0
        if held:
            yield block(held)

    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    ordered = rows.withColumn("_length", length).repartitionByRange(F.desc("_length"), F.col("id"))
    return ordered.sortWithinPartitions(F.desc("_length"), "id").select("id", "vector").mapInArrow(pack, BLOCK)


def _products(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of whole-number rows, exact: beyond what doubles hold, by Python's integers."""
    if bound < EXACT:
        return q @ c.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return whole(q) @ whole(c).T


class Found:
    """The best ``k`` candidates of each query so far, and the score that a newcomer must reach."""

    def __init__(self, theta: np.ndarray, k: int):
        self.theta, self.k = theta, k
        self.ids: list[list[int]] = [[] for _ in theta]
        self.scores: list[list[int]] = [[] for _ in theta]

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = self.ids[i] + ids.tolist(), self.scores[i] + [int(s) for s in scores.tolist()]
        order = sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[: self.k]
        self.ids[i], self.scores[i] = [ids[j] for j in order], [scores[j] for j in order]
        if len(order) == self.k:
            self.theta[i] = max(self.theta[i], float(self.scores[i][-1]))


def _near_axes(q: np.ndarray, least: float, columns: np.ndarray, order: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Places of unit vectors that can have a cosine of ``least`` or more with ``q``, by its largest coordinates.

    A vector within the angle ``b`` of ``q`` lies within ``a - b`` and ``a + b`` of an axis at angle ``a`` from ``q``.
    """
    focus = np.argsort(-np.abs(q))[:FOCUS]
    a, b = np.arccos(np.clip(q[focus], -1, 1)), np.arccos(min(1.0, least))
    low, high = np.cos(np.minimum(np.pi, a + b)) - SLACK, np.cos(np.maximum(0.0, a - b)) + SLACK
    starts = [np.searchsorted(columns[f], x, "left") for f, x in zip(focus, low)]
    ends = [np.searchsorted(columns[f], x, "right") for f, x in zip(focus, high)]
    first = int(np.argmin(np.subtract(ends, starts)))
    places = order[focus[first]][starts[first] : ends[first]]
    for j, f in enumerate(focus):
        if j != first:
            x = unit[places, f]
            places = places[(x >= low[j]) & (x <= high[j])]
    return places


def search_group(q_ids, q_lengths, q, theta, c_ids, c_lengths, c, k: int, found: Found | None = None) -> Found:
    """The ``k`` best candidates of a group for each query that reach its ``theta``, a query's own row left out.

    With ``found``, the group's candidates are added to those of groups before it.

    Per bucket, ``theta / (query's length * longest)`` is the cosine that a candidate needs. Above 1 the bucket is
    passed over. From ``COORDINATES_FROM`` on, single coordinates select the candidates; below, only those as
    long as the query needs are multiplied.
    """
    found = found or Found(theta.copy(), k)
    for start in range(0, len(c_ids), BUCKET_ROWS):
        part = slice(start, start + BUCKET_ROWS)
        ids, lengths, rows = c_ids[part], c_lengths[part], c[part].astype(np.float64)
        longest = lengths[0]
        reach = q_lengths * longest
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(found.theta <= 0, -1.0, found.theta / reach)
        least = np.where(np.isnan(least), -1.0, least)
        alive = least <= 1 + SLACK
        narrow = alive & (least >= COORDINATES_FROM)
        wide = np.flatnonzero(alive & ~narrow)
        if narrow.any():
            unit = rows / np.where(lengths > 0, lengths, 1)[:, None]
            order = np.argsort(unit, axis=0).T
            columns = [unit[o, f] for f, o in enumerate(order)]
            for i in np.flatnonzero(narrow):
                places = _near_axes(q[i] / q_lengths[i], least[i] - SLACK, columns, order, unit)
                places = places[(ids[places] != q_ids[i]) & (lengths[places] * q_lengths[i] >= found.theta[i] * (1 - SLACK))]
                if len(places):
                    scores = _products(q[i : i + 1], rows[places], float(reach[i]))[0]
                    hits = np.flatnonzero(scores >= found.theta[i])
                    if len(hits):
                        found.add(i, ids[places[hits]], scores[hits])
        if len(wide):
            need = np.where(found.theta[wide] > 0, found.theta[wide] * (1 - SLACK), 0) / np.where(q_lengths[wide] > 0, q_lengths[wide], 1)
            n = int(np.searchsorted(-lengths, -need, "right").max())
            if not n:
                continue
            scores = _products(q[wide], rows[:n], float(reach[wide].max()))
            hit = (scores >= found.theta[wide][:, None]) & (ids[None, :n] != q_ids[wide][:, None])
            for r in np.flatnonzero(hit.any(1)):
                at = np.flatnonzero(hit[r])
                found.add(wide[r], ids[at], scores[r, at])
    return found


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["lengths"], "<f8"), np.frombuffer(row["data"], row["number"]).reshape(len(ids), -1)


def _searched(row: dict, theta: np.ndarray, groups: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, Found]:
    """Ids and lengths of a block of queries, and what they find in the groups, the longest first."""
    ids, lengths, data = _arrays(row)
    found, data = Found(theta.copy(), k), data.astype(np.float64)
    for group in groups:
        search_group(ids, lengths, data, theta, *group, k, found)
    return ids, lengths, found


def held_groups(groups: DataFrame) -> DataFrame:
    """``block, held``: runs of groups, about ``HOLD_BYTES`` each, numbered from 0 by falling length.

    Sizes are summed up within the tasks that made the groups, and one row per such task across them.
    """
    size = F.octet_length("data") + F.octet_length("lengths") + F.octet_length("ids")
    sized = groups.select("block", F.shiftright("block", 24).alias("_task"), size.cast("bigint").alias("_size"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = sized.groupBy("_task").agg(F.sum("_size").alias("_size"))
    starts = tasks.select("_task", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_task").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    return sized.join(starts, "_task").select("block", F.floor(at / HOLD_BYTES).alias("held"))


def _cells(groups: DataFrame, asked: DataFrame, tasks: int) -> tuple[DataFrame, int]:
    """Groups and the blocks of queries that can matter to them, by cell ``held, deal``, and how many cells there are.

    A cell is a run of groups and one deal of the query blocks. One run meets all queries if there are as many
    runs as tasks; fewer runs meet them in several deals, so that every task has work. A group is sent once for
    each deal, which the number of tasks bounds; a block of queries once for each run that is long enough for it.
    """
    numbered = groups.join(held_groups(groups), "block")
    # Runs in the order of their numbers: their longest lengths fall, so a block of queries needs the first few.
    runs = numbered.groupBy("held").agg(F.max("longest").alias("longest"))
    levels = runs.agg(F.sort_array(F.collect_list("longest"), asc=False).alias("_levels"), F.count(F.lit(1)).alias("_runs"))
    levels = cut_lineage(levels)
    n_runs, n_blocks = levels.first()["_runs"], asked.count()
    deals = max(1, min(n_blocks, -(-tasks // max(1, n_runs))))
    none = {"theta": "binary", "first": "bigint"}
    packed = ["block", "ids", "lengths", "number", "data"]
    reach = F.size(F.filter("_levels", lambda x: x >= F.col("need")))
    blocks = asked.crossJoin(F.broadcast(levels)).withColumn("_reach", reach).where("_reach > 0")
    runs_met = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_reach").cast("bigint") - 1))
    deal = F.pmod(F.xxhash64("block"), F.lit(deals)).cast("int")
    sent = blocks.select(deal.alias("deal"), F.lit(1).alias("role"), *packed, *none, runs_met.alias("held"))
    every = F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))
    met = blocks.agg(F.max("_reach").alias("_most"))
    held = numbered.crossJoin(F.broadcast(met)).where("held < _most")
    kept = held.select(every.alias("deal"), F.lit(0).alias("role"), *packed, *(F.lit(None).cast(t).alias(c) for c, t in none.items()), "held")
    return kept.unionByName(sent), n_runs * deals


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` candidates of other ids with the largest inner product.

    Components must be whole numbers held as doubles; scores are exact longs, and one that a long can't hold is
    an error. Ties go to the smaller id. Queries and candidates are packed into blocks by falling length, their
    components in the shortest whole numbers that hold them. First every block of queries meets the group of the
    longest vectors, which gives each query a score to reach; then tasks hold runs of the other groups, and the
    blocks of queries whose scores those can reach pass by (see ``_cells``). Results are merged.

    Null vectors or those with a null or not finite component take no part, nor rows without an id. Rows that
    share an id count as one (see ``one_per_id``); shorter vectors are filled with zeros. A zero vector scores 0.
    Fewer than ``k`` candidates are all returned; an empty table gives no rows; other columns are left out.
    """
    queries, candidates = one_per_id(queries, id_col, vector_col), one_per_id(candidates, id_col, vector_col)
    sizes = [df.agg(F.max(F.size("vector"))).first()[0] or 0 for df in (queries, candidates)]
    dim = max(*sizes, 1)
    asked = cut_lineage(_blocks(queries, dim, QUERY_ROWS))
    groups = cut_lineage(_blocks(first_of_equals(candidates, k + 1), dim, GROUP_ROWS))
    first = groups.orderBy(F.desc("longest"), "block").limit(1).select(F.struct("block", "ids", "lengths", "number", "data").alias("group"))

    def seed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, lengths, found = _searched(row, np.full(row["n"], -np.inf), [_arrays(row["group"])], k)
                need = np.where(found.theta > 0, found.theta, 0) * (1 - SLACK) / np.where(lengths > 0, lengths, 1)
                counts = [len(x) for x in found.ids]
                best = [ids.repeat(counts).tolist(), sum(found.ids, []), sum(found.scores, [])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]]), pa.array([row["group"]["block"]]), pa.array([float(need.min())]),
                     pa.array([found.theta.astype("<f8").tobytes()], pa.binary()), *(pa.array([x], pa.list_(pa.int64())) for x in best)],
                    ["block", "first", "need", "theta", "query_ids", "vec_ids", "scores"])

    def rest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["held"], row["deal"]) != cell:
                    cell, held = (row["held"], row["deal"]), []
                if row["role"] == 0:
                    held.append((row["block"], _arrays(row)))
                    continue
                groups = [group for block, group in held if block != row["first"]]
                ids, _, found = _searched(row, np.frombuffer(row["theta"], "<f8"), groups, k)
                counts = [len(x) for x in found.ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (ids.repeat(counts).tolist(), sum(found.ids, []), sum(found.scores, []))],
                    ["query_id", "vec_id", "score"])

    spark = queries.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    seeds = cut_lineage(bounded(asked.repartition(tasks, "block").crossJoin(F.broadcast(first))).mapInArrow(
        seed, "block bigint, first bigint, need double, theta binary, query_ids array<bigint>, vec_ids array<bigint>, scores array<bigint>"))
    work, n_cells = _cells(groups, asked.join(seeds.select("block", "first", "need", "theta"), "block"), tasks)
    spread = work.repartition(max(1, min(2 * n_cells, 4 * tasks)), "held", "deal").sortWithinPartitions("held", "deal", "role", "block")
    more = spread.mapInArrow(rest, "query_id bigint, vec_id bigint, score bigint")
    each = F.explode(F.arrays_zip("query_ids", "vec_ids", "scores")).alias("x")
    begun = seeds.select(each).select(F.col("x.query_ids").alias("query_id"), F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"))
    return ranked(begun.unionByName(more), k)
