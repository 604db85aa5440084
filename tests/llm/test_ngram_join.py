import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wattframe.llm import ngram_join
from wattframe.llm.components import components
from wattframe.llm.words import windows, words


def sets_of(rows, size):
    out = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(found[i : i + size]) for i in range(max(len(found) - size + 1, min(1, len(found))))})
    return out


def expected(rows, size, num, den):
    sets, root = sets_of(rows, size), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * (len(a) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(doc)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((d, len(sets[i]), d if not sets[i] else least[top(i)]) for i, (d, _) in enumerate(rows)), key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, key string, component string")
    got = ngram_join.near_duplicates(df, **how).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def texts(kind, rng):
    prose = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    if kind == "group":  # many near copies of one text, some of them too far from all others
        base = prose(160)
        return [" ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4, 8]))) for _ in range(240)] + [" ".join(prose(120)) for _ in range(60)]
    if kind == "chain":  # each close to the next only
        now, out = prose(200), []
        for _ in range(60):
            now = edited(rng, now, 2)
            out.append(" ".join(now))
        return out
    if kind == "short":
        return [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(200)]
    if kind == "passage":  # a common passage in otherwise different texts, and copies of them
        common = prose(60)
        out = [" ".join(prose(rng.randrange(30)) + common + prose(rng.randrange(30))) for _ in range(120)]
        return out + [t.upper() for t in out[::5]] + [t.replace(" ", "\n\t ", 7) for t in out[::7]]
    if kind == "long":
        base = prose(6000)
        return [" ".join(edited(rng, base, c)) for c in (0, 30, 60, 90, 200, 300)] + [" ".join(base[:5000]), " ".join(base[:5200])]


@pytest.mark.parametrize("kind", ["group", "chain", "short", "passage", "long"])
@pytest.mark.parametrize("size,share", [(4, (85, 100)), (5, (80, 100))])
def test_same_as_all_pairs(spark, kind, size, share):
    rng = random.Random(kind)
    rows = [(3 * i + 7, t) for i, t in enumerate(texts(kind, rng))]
    rng.shuffle(rows)
    assert found(spark, rows, size=size, share=share) == expected(rows, size, *share)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_ENTRY", 2)
    rng = random.Random(9)
    rows = list(enumerate(texts("group", rng)))
    assert found(spark, rows, size=4, share=(85, 100)) == expected(rows, 4, 85, 100)


@pytest.mark.parametrize("small_entry", [2, 16])
def test_every_link(spark, monkeypatch, small_entry):
    """All links between rows, also those of classes that others have joined."""
    monkeypatch.setattr(ngram_join, "SMALL_ENTRY", small_entry)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 64)
    rng = random.Random(11)
    plain = texts("group", rng)
    rows = [(i, t) for i, t in enumerate(plain + plain[:30] + texts("chain", rng) + ["", None])]
    sets = sets_of(rows, 4)
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 85 * len(a | b)}
    members, pairs = ngram_join.links(spark.createDataFrame(rows, "doc_id int, text string"), 4, (85, 100))
    members, pairs = members.collect(), [(r["class"], r.other) for r in pairs.collect()]
    assert len(members) == len(rows) and len(set(pairs)) == len(pairs) and all(a < b for a, b in pairs)
    kind = {r.doc_id: r["class"] for r in members}
    known = set(pairs)
    got = {(i, j) for i in kind for j in range(i) if kind[i] and kind[j] and (kind[i] == kind[j] or (min(kind[i], kind[j]), max(kind[i], kind[j])) in known)}
    assert got == want
    assert {r.doc_id: r.n_links for r in members} == {i: sum(i in x for x in want) for i in kind}


def test_share_below_half(spark):
    """Sets of 128 and 64 shingles, one inside the other, share a band."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(131)]
    rows = [(1, " ".join(words)), (2, " ".join(words[20:87]))]
    assert found(spark, rows, size=4, share=(40, 100)) == expected(rows, 4, 40, 100) == [(1, 128, 1), (2, 64, 1)]
    for share in ((1, 2), (80, 100), (85, 100)):
        for n in range(1, 3000):
            low = -(-share[0] * n // share[1])
            assert ngram_join._bands(n, share) == {low.bit_length() - 1, n.bit_length() - 1}


def test_odd_rows(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(9, None), (8, ""), (7, " \n\t"), (8, ""), (5, long), (5, long), (4, long.upper()), (None, long), (None, "x y"), (None, None),
            (3, "a b"), (2, "A  b"), (1, "b a"), (6, "é" * 5000), (10, "é" * 5000), (11, "É" * 5000), (5, "another text with the same id here")]
    assert found(spark, rows, size=4, share=(85, 100)) == expected(rows, 4, 85, 100)
    assert found(spark, []) == []


def test_words():
    rng = random.Random(2)
    rows = ["".join(rng.choice("ab é\t\n\x0b\x0c\r\x1f ") for _ in range(rng.randrange(60))) for _ in range(300)] + ["x" * 3000 + " y", None]
    got = words(pa.array(rows))
    seen = {}
    for i, text in enumerate(rows):
        want = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        part = slice(got.first[i], got.first[i + 1])
        assert [got.data[a:b].tobytes() for a, b in zip(got.starts[part], got.ends[part])] == want
        for word, h in zip(want, got.hashes[part].tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(windows(got.hashes[:3], 4)) == 0
    a = np.array([1, 2, 3, 1, 2, 3], np.uint64)
    h = windows(a, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 3


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100)] + [(500, 600 + i) for i in range(200)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)]
    rng.shuffle(links)
    root = {x: x for link in links for x in link}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    loose = {a for a, b in links if a == b}
    assert {x: top(x) for x in root if x in got} == got and set(root) - set(got) <= loose
