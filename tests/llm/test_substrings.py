import collections
import hashlib
import os
import random
import time

import numpy as np
import pytest

from wattframe.llm import substring, suffixes
from wattframe.llm.suffixes import common, multikey_order, repeated
from wattframe.llm.words import column_bytes
from wattframe.session import FREE_SHUFFLES

SCHEMA = "doc_id long, text string, key string, id int, part string, kept int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA)


def without_repeated_words(rows, size):
    least, out = {}, []
    order = lambda i: float("inf") if i is None else i
    for i, text in rows:
        words = (text or "").encode().split()
        for p in range(len(words) - size + 1):
            w = tuple(words[p : p + size])
            least[w] = min(least.get(w, float("inf")), order(i))
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for p in range(len(words) - size + 1):
            if least[tuple(words[p : p + size])] < order(i):
                gone.update(range(p, p + size))
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), kept.decode()))
    return sorted(out, key=str)


def prose(rng, n, vocabulary=300):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed):
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (12, 13, 14, 30, 80, 200)]
    rows = []
    for i in range(220):
        words = prose(rng, rng.randrange(60))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((rng.randrange(10**6) * 7, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(rng.randrange(10**6) * 7, t) for _, t in rows[:20]]
    return rows + [(1, None), (2, ""), (3, " \n"), (None, rows[0][1]), (None, " ".join(passages[4])), rows[5], rows[5], (rows[6][0], rows[7][1])]


def test_words_of_earlier_documents(spark, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET_WINDOWS", 1000)
    rows = corpus(1)
    got = substring.remove_repeats(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == without_repeated_words(rows, 13)
    got = substring.remove_repeats(frame(spark, rows).repartition(7), size=5).collect()
    assert sorted(map(tuple, got), key=str) == without_repeated_words(rows, 5)
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_batches_judged_apart(spark, monkeypatch):
    """Windows judged inside a batch don't meet those of other batches, whatever their tasks."""
    monkeypatch.setattr(substring, "BATCH_WINDOWS", 200)
    rows = [(i, " ".join(prose(random.Random(i % 2), 40))) for i in range(90)]
    docs = frame(spark, rows).repartition(6)
    packed = substring._packed(docs.selectExpr("doc_id AS id", "text"), 13, 3)
    assert packed.where("bucket < 0").count() > 6
    assert packed.where("bucket < 0").groupBy("bucket").count().where("count > 1").count() == 0
    assert sorted(map(tuple, substring.remove_repeats(docs).collect()), key=str) == without_repeated_words(rows, 13)


def without_repeated_bytes(rows, length):
    count = collections.Counter()
    data = [(t or "").encode() for _, t in rows]
    digest = lambda d, p: hashlib.md5(d[p : p + length]).digest()
    for d in data:
        count.update(digest(d, p) for p in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data):
        cover = np.zeros(len(d) + 1, int)
        for p in range(len(d) - length + 1):
            if count[digest(d, p)] > 1:
                cover[p] += 1
                cover[p + length] -= 1
        stay = np.cumsum(cover)[:-1] == 0
        spans = int((~stay & np.r_[True, stay[:-1]]).sum()) if len(d) else 0
        out.append((i, len(d), len(d) - int(stay.sum()), spans, bytes(np.frombuffer(d, np.uint8)[stay]).hex()))
    return sorted(out, key=str)


def taken(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept).hex()) for r in df.collect()), key=str)


def strings(seed):
    rng = random.Random(seed)
    word = lambda n, s: "".join(rng.choice(s) for _ in range(n))
    passages = [word(n, "abcdé ") for n in (20, 24, 25, 30, 60, 150)]
    rows = []
    for i in range(260):
        text = word(rng.randrange(90), "abcdefgé")
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            text += (p if rng.random() < 0.5 else p[a : a + rng.randrange(len(p))]) + word(rng.randrange(20), "abcdefgé")
        rows.append((i, text))
    rows += [(300 + i, t) for i, t in rows[:9]]
    rows += [(400, None), (401, ""), (402, "a" * 3000), (403, "ab" * 900), (404, "xyz" * 500 + "ab" * 40), (None, passages[5]), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("length", [24, 40])
def test_repeated_bytes(spark, length):
    rows = strings(length)
    assert taken(suffixes.remove_repeats(frame(spark, rows), length)) == without_repeated_bytes(rows, length)


def test_overfull_grams(spark):
    """Counting windows gives what sorting gives."""
    rows = [r for r in strings(7) if len(r[1] or "") < 1000]
    for most in (1, 3):
        assert taken(suffixes.remove_repeats(frame(spark, rows), 24, group_segments=most)) == without_repeated_bytes(rows, 24)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = taken(suffixes.remove_repeats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    assert got == without_repeated_bytes(rows, 400)
    assert sum(r[2] for r in got) > 0


def shuffle_files(spark):
    """Sizes of the files that shuffles have left."""
    tops = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    found = [f"{d}/{x}" for top in tops for d, _, names in os.walk(top) for x in names if x.startswith("shuffle_")]
    return {f: os.path.getsize(f) for f in found if os.path.exists(f)}


def test_steps_leave_no_shuffles(spark):
    """When the spans are known, the texts and segments that were shuffled to find them are off the disk."""
    rng = random.Random(12)
    passages = [rng.randbytes(400).hex() for _ in range(20)]
    rows = [(i, rng.randbytes(500).hex() + rng.choice(passages)) for i in range(600)]
    before = shuffle_files(spark)
    found = suffixes.remove_repeats(frame(spark, rows))
    left = lambda: sum(n for f, n in shuffle_files(spark).items() if f not in before)
    for _ in range(20):  # executors are told, and not waited for
        if left() < 50_000:
            break
        time.sleep(0.5)
    assert left() < 50_000 < sum(len(t) for _, t in rows) / 20
    assert taken(found) == without_repeated_bytes(rows, 400)
    assert spark.conf.get(FREE_SHUFFLES, None) != "true"


def test_text_without_broken_characters(spark):
    text = "é" * 30 + "tail"
    got = suffixes.remove_repeats(frame(spark, [(1, "x" + text), (2, "y" + text[1:])]), 15).collect()
    for r in got:
        assert bytes(r.kept).decode("utf-8", "ignore") == r.text
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0


def test_multikey_order():
    rng = random.Random(5)
    for _ in range(50):
        s = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(70))) for _ in range(rng.randrange(40))]
        s += s[:3]
        assert [s[i] for i in multikey_order(s)] == sorted(s)
    assert common(b"abcd", b"abxd") == 2 and common(b"", b"a") == 0 and common(b"ab", b"ab") == 2


def test_repeated_segments():
    """Three and more segments against counting windows at each place."""
    rng = random.Random(8)
    for _ in range(200):
        length, segments, counts = 12, [], []
        for _ in range(rng.randrange(1, 8)):
            at = rng.randrange(1, 9)
            right = rng.randrange(12 - at, 13)
            s = bytes(rng.choice(b"ab") if rng.random() < 0.15 else 97 for _ in range(at + right))
            if (s, at) not in segments:
                segments.append((s, at))
                counts.append(rng.choice([1, 1, 1, 2]))
        seen = collections.Counter()
        for (s, at), n in zip(segments, counts):
            for p in range(len(s) - length + 1):
                seen[at - p, s[p : p + length]] += n
        for (s, at), intervals in zip(segments, repeated(segments, counts, length)):
            got = {p for a, b in intervals for p in range(a, b)}
            want = {q for p in range(len(s) - length + 1) if seen[at - p, s[p : p + length]] > 1 for q in range(p, p + length)}
            assert got == want


def test_one_interval_for_windows_that_overlap():
    rng = random.Random(5)
    common_part = bytes(rng.choices(range(65, 90), k=60))
    segments = []  # all share a stretch of their own length around the anchor: classes change at many distances
    for _ in range(60):
        a, b = rng.randrange(12, 30), rng.randrange(12, 30)
        tail = lambda n: bytes(rng.choices(range(97, 122), k=n))
        segments.append((tail(30 - a) + common_part[30 - a : 30 + b] + tail(30 - b), 30))
    found = repeated(segments, [1] * 60, 24)
    assert sum(map(len, found)) == sum(map(bool, found)) > 30


def test_column_bytes():
    import pyarrow as pa

    data, offsets = column_bytes(pa.array(["ab", None, "", "é"]).slice(1))
    assert data.tobytes() == "é".encode() and offsets.tolist() == [0, 0, 0, 2]
