import random

import pytest

from wattframe.llm import licenses

DOCS = "doc_id long, text string, _row long, places string, _marks int, n_words int"
WORDS = ["under", "the", "mit", "license", "cc", "by", "nc", "apache", "version", "2", "is", "of", "and", "über", "x"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "p", 1, 2) for i, t in rows], DOCS)


def by_hand(text, phrases, templates, share=licenses.SHARE):
    words = licenses.split(text or "")
    places = sorted((i, label) for label, phrase in phrases for p in [licenses.split(phrase)]
                    for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p)
    step, blocks = licenses.stride(templates), []
    for start in range(0, len(words), step):
        held = set(words[start : start + 2 * step])
        for label, template in templates:
            tokens = set(licenses.split(template))
            if len(held & tokens) >= licenses.needed(len(tokens), share):
                blocks.append((label, start, len(held & tokens), len(tokens)))
    return len(words), [(label, i) for i, label in places], sorted(set(blocks))


def check(spark, rows, phrases=licenses.PHRASES, templates=licenses.TEMPLATES, share=licenses.SHARE):
    got = licenses.scan(frame(spark, rows), phrases, templates, share)
    assert got.columns == ["doc_id", "n_words", "places", "blocks"]
    got = sorted(str((r.doc_id, r.n_words, [tuple(p) for p in r.places], sorted(tuple(b) for b in r.blocks))) for r in got.collect())
    assert got == sorted(str((i, *by_hand(t, phrases, templates, share))) for i, t in rows)


def notice(rng, text, lost=0):
    words = text.split()
    for _ in range(lost):
        words[rng.randrange(len(words))] = "lost"
    return " ".join(words)


def test_notices_and_phrases(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(120))]
        if i % 3 == 0:
            words.insert(rng.randrange(len(words) + 1), notice(rng, rng.choice(licenses.TEMPLATES)[1], i % 7))
        if i % 4 == 0:
            words.insert(rng.randrange(len(words) + 1), "Under THE mit-license, CC BY-NC; the Apache License, Version 2.0")
        rows.append((i, " ".join(words)))
    check(spark, rows)
    check(spark, rows, share=(1, 2))
    assert any(by_hand(t, licenses.PHRASES, licenses.TEMPLATES)[2] for _, t in rows)


def test_odd_rows(spark):
    line = "Released under the MIT License. "
    rows = [(1, None), (2, ""), (None, line), (3, line), (3, line), (4, "KK İ éÉ cc by nc\x7fcc by nc"), (5, "...")]
    rows += [(6, "word " * 30_000 + licenses.TEMPLATES[1][1] + " the of and" * 20_000 + " " + line * 900)]
    rows += [(9, line)] * 40
    check(spark, rows)


def test_nothing(spark):
    assert licenses.scan(frame(spark, [])).count() == 0
    rows = [(1, "under the mit license"), (2, None)]
    check(spark, rows, templates=())
    check(spark, rows, phrases=())
    got = licenses.scan(frame(spark, rows), (), ()).collect()
    assert [(r.places, r.blocks) for r in got] == [([], []), ([], [])]
    with pytest.raises(ValueError):
        licenses.scan(frame(spark, rows), templates=[("x", " ".join(f"w{i}" for i in range(licenses.MAX_WORDS + 1)))])


def test_no_python(spark):
    plan = licenses.scan(frame(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
