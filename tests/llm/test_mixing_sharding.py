import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from wattframe.llm import mixing, queries, sharding
from wattframe.llm.common import source_key, word_count

DOCS = "doc_id long, text string, source string, size string, _rows int, _bin int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], DOCS)


def filled(sizes, weights):
    """Reshare the excess again and again."""
    target = {s: 0.0 for s in sizes}
    rest, open_ = float(sum(sizes.values())), set(sizes)
    while rest > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        share, rest = rest, 0.0
        for s in list(open_):
            target[s] += share * weights[s] / total
            if target[s] >= 3 * sizes[s]:
                rest += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def test_mix(spark):
    rows = [(i, "w " * (1 + i % 7), None if i % 50 == 0 else f"s{min(i % 9, 4)}" if i > 60 else "tiny") for i in range(800)]
    rows += [(800, None, "empty"), (801, "", "empty"), (None, "a b", "s1"), (5, "a", "s2"), (5, "a", "s2")]
    got = mixing.mix(mixing.measured(documents(spark, rows), word_count(F.col("text")))).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 4 for s in sizes)
    again = mixing.mix(mixing.measured(documents(spark, rows[::-1]).repartition(3), word_count(F.col("text")))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_quality_comes_first(spark):
    rows = [(i, f"s{i % 2}", 10, None if i % 5 == 0 else 8.0 if i % 3 else 0.0) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, quality double")
    got = mixing.mix(df, weights=(1.0, 3.0)).where("source = 's0'").collect()
    share = lambda q: sum(r.copies for r in got if q(r)) / max(1, sum(1 for r in got if q(r)))
    quality = {r[0]: r[3] for r in rows}
    assert share(lambda r: quality[r.doc_id] == 8.0) > share(lambda r: quality[r.doc_id] is None) > 0
    assert share(lambda r: quality[r.doc_id] == 0.0) == 0


def test_mix_empty(spark):
    assert mixing.mix(mixing.measured(documents(spark, []), word_count(F.col("text")))).count() == 0
    only = mixing.mix(mixing.measured(documents(spark, [(1, None, None)]), word_count(F.col("text")))).collect()
    assert [(r.taken, r.target) for r in only] == [(0, 0.0)]


def test_interleave(spark):
    rows = [(i, "é" * (i % 5), None if i % 9 == 0 else "hot" if i % 3 else f"s{i % 4}") for i in range(9000)] + [(1, None, "x")] * 3
    df = sharding.measured(documents(spark, rows))
    got = sharding.interleave(df, 40).collect()
    assert len(got) == len(rows)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    counts = [len(shards[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and set(shards) == set(range(40))
    hot = sum(1 for r in rows if r[2] == "hot") / len(rows)
    for part in shards.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r.source == "hot" for r in part) - hot * len(part)) <= 2
    text = {i: t for i, t, _ in rows[2:]}
    for r in got:
        if r.doc_id != 1:
            data = text.get(r.doc_id, "").encode()
            assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data)
    again = sharding.interleave(sharding.measured(documents(spark, rows[::-1])), 40).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_interleave_small(spark):
    assert sharding.interleave(sharding.measured(documents(spark, [])), 40).count() == 0
    few = sharding.interleave(sharding.measured(documents(spark, [(1, "a", "x"), (2, None, None)])), 40).collect()
    assert sorted(r.slot for r in few) == [0, 0] and len({r.shard for r in few}) == 2


def test_sharding_query_equals_its_law(spark):
    """The registered query on the whole table: ranks within sources, then all by fraction, in plain Python."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text", source_key().alias("g")).collect()
    rows = []
    for r in docs:
        data = (r.text or "").encode()
        size, crc = len(data) + 16, zlib.crc32(data)
        digest = hashlib.md5(f"1:{r.doc_id}:{crc}:{size}".encode()).hexdigest()
        rows.append(((int(digest[:13], 16) + 0.5) / 16**13, r.doc_id, crc, size, r.g))
    placed, counts, seen = [], collections.Counter(r[-1] for r in rows), collections.Counter()
    for u, doc, crc, size, group in sorted(rows):
        placed.append(((seen[group] + 0.5) / counts[group], group, doc, crc, size))
        seen[group] += 1
    n, want = len(placed), []
    for at, (_, _, doc, crc, size) in enumerate(sorted(placed)):
        shard = at * 40 // n
        want.append((doc, size, crc, "rows", shard, at - -(-shard * n // 40), None))
    got = queries.op10_sharding(spark, folder)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
