import functools
import hashlib
import random
import zlib

import numpy as np
import pytest

from wattframe.llm import queries, trie

ROWS = "conv_id long, turn long, role string, text string, depth int, part string, words int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], ROWS)


def rebuilt(rows):
    own = {}
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    for conv, turn, role, text in sorted(
            (r for r in rows if r[0] is not None),
            key=lambda r: (r[0], r[1] is not None, r[1] or 0, digest(r[2] or "", r[3] or ""))):
        own.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        rest = abs(conv) % 20 * (1 if conv >= 0 else -1)
        out[conv] = own.get(conv - rest, [])[:h] + turns[h:]
    return out


def by_hand(convs):
    nodes = {}
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    words = lambda t: len([w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w])

    @functools.cache
    def sums(path):
        below = [sums(c) for c in children.get(path, [])]
        own = (len(nodes[path]) - 1) * words(path[-1][1]) if path else 0
        return sum(a for a, _ in below) or 1, own + sum(b for _, b in below)

    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(path)))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                    len(children.get(path, [])), *sums(path), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    got = trie.trie(*trie.rebuilt(frame(spark, rows)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "said"]
    assert sorted((tuple(r)[:-1] for r in got.collect()), key=str) == by_hand(rebuilt(rows))


def conversations(seed, n=300, most=9):
    """Two thirds of all begin alike; copies, empty and repeated turns, nulls."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        conv = rng.choice([i, i, i, -i, 7 * i])
        length = rng.randrange(most)
        for k in range(length):
            text = f"hot {k}." if i % 3 and k < 5 else rng.choice(["a b", "", None, "c  d\te\n", f"é {i % 11}"])
            rows.append((conv, rng.choice([k, k, k, None]), ("user", "assistant", None)[min(k % 2 + (rng.random() < 0.1), 2)], text))
    rows += [r for r in rows if r[0] % 5 == 0] + [(None, 1, "user", "x")]
    return rows


def test_double_array():
    rng = np.random.default_rng(1)
    seqs = sorted({tuple(rng.integers(0, 1 + 60 // (d + 1), size=d)) for d in rng.integers(1, 9, 600)})
    lengths = np.array([len(s) for s in seqs])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    array, node_of = trie.pack(np.concatenate([np.array(s) for s in seqs]), first, lengths)
    seen = {}
    for k, s in enumerate(seqs):
        at = np.zeros(1, np.int64)
        for d, i in enumerate(s):
            at = array.step(at, np.array([i]))
            assert at[0] == node_of[first[k] + d] and array.depth[at[0]] == d
            assert seen.setdefault(int(at[0]), s[: d + 1]) == s[: d + 1]
    assert len(seen) == len({s[: d + 1] for s in seqs for d in range(len(s))}) == (array.check >= 0).sum()
    assert array.step(np.zeros(1, np.int64), np.array([10**6]))[0] == -1


def test_double_array_of_consecutive_siblings(monkeypatch):
    """First turns of a sorted run have ids in a row; their families, spread over all ids, still take few cells."""
    grow = trie.DoubleArray._grow

    def small(self, size):
        assert size < 50_000
        grow(self, size)

    monkeypatch.setattr(trie.DoubleArray, "_grow", small)
    rng = np.random.default_rng(3)
    seqs = sorted({(1, 1_000 + i, int(x)) for i in range(900) for x in rng.integers(0, 9_000, 6)})
    lengths = np.full(len(seqs), 3)
    array, node_of = trie.pack(np.array(seqs).ravel(), 3 * np.arange(len(seqs)), lengths)
    assert len(array.check) < 4 * len(seqs) + 9_000
    assert len(set(node_of.tolist())) == len({s[: d + 1] for s in seqs for d in range(3)}) == (array.check >= 0).sum()


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes(spark, seed):
    check(spark, conversations(seed))


@pytest.mark.parametrize("rows, level", [(12, 1024), (50, 3), (10**6, 1), (15, 2)])
def test_small_tries_and_levels(spark, monkeypatch, rows, level):
    """Tries of few sequences, whose upper nodes are merged again and again, and conversations of several levels."""
    tries = trie._tries

    def small(batches, whole, depth):
        trie.CHUNK_ROWS = rows  # in the worker
        try:
            yield from tries(batches, whole, depth)
        finally:
            trie.CHUNK_ROWS = 4_096

    monkeypatch.setattr(trie, "CHUNK_ROWS", rows)
    monkeypatch.setattr(trie, "LEVEL", level)
    monkeypatch.setattr(trie, "_tries", small)
    check(spark, conversations(rows + level, n=200))


def test_odd_tables(spark):
    assert trie.trie(*trie.rebuilt(frame(spark, []))).count() == 0
    check(spark, [(3, None, None, None)])
    for conv in range(40):  # an id whose rebuilt conversation has no turns
        if zlib.crc32(str(conv).encode()) % 4 > 0 and conv % 20:
            check(spark, [(conv, 0, "user", "x")])
            break
    check(spark, [(1, k, "user", f"long {k} " * 50) for k in range(700)] + [(2, 0, "user", "y" * 200_000)])


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    got = queries.op13_trie(spark, folder).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_hand(rebuilt(rows))
