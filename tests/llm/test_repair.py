import functools
import hashlib
import random
import zlib

import pytest

from wattframe.llm import queries, repair

ROWS = "conv_id long, turn long, role string, text string, copies int, part string, block int, audit string"
AFTER = {0: 2, 1: 2, 2: 3, 3: 2}


def cheapest(turns):
    """Cost and audit by trying every edit from every place, back to front."""

    @functools.cache
    def best(i, state, inserts):
        options = []
        if i < len(turns):
            initial, fault = turns[i]
            options.append((2, "D", i + 1, state, 0))
            if fault in (repair.FINE, repair.CUT):
                extra = 5 * (fault == repair.CUT)
                after = repair.keeps(initial, state)
                if after is not None:
                    options.append((extra, "K", i + 1, after, 0))
                options.append((1 + extra, "R", i + 1, AFTER[state], 0))
        if inserts < 3:
            options.append((5, "I", i, AFTER[state], inserts + 1))
        found = [(0, "")] if i == len(turns) and state in (0, 3) else []
        for price, letter, *place in options:
            tail = best(*place)
            if tail is not None:
                found.append((price + tail[0], letter + tail[1]))
        return min(found, default=None)

    return best(0, 0, 0)


def by_hand(rows):
    """The contract's result for damaged rows ``(conv, turn, role, text, copies)``."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "", r[4]) for r in rows if r[0] == conv))
        own = [r for r in own for _ in range(r[4])]
        seen, turns, marks = set(), [], []
        for _, _, role, text, _ in own:
            end = text.rstrip(" \t\n\x0b\f\r")
            fault = 1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0
            seen.add((role, text))
            turns.append((role, text, fault))
            marks.append((role[:1], fault))
        cost, audit = cheapest(tuple(marks))
        made, state, at = [], 0, 0
        for letter in audit:
            role, text, _ = turns[at] if letter != "I" else ("", "", 0)
            at += letter != "I"
            if letter == "D":
                continue
            if letter == "K":
                state = repair.keeps(role[:1], state)
            else:
                state = AFTER[state]
                role = "user" if state == 2 else "assistant"
            made.append(f"{role}:{text}")
        numbers = [r[1] for r in own if r[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults = [f for _, f in marks]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit,
                     hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "a") for r in rows], ROWS)


def check(spark, rows):
    got = repair.repair(frame(spark, rows)).collect()
    want = by_hand(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in repair.SUMMARY) == want[r.conv_id], r.conv_id


def conversation(rng, conv, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    texts = ["Yes.", "No!", "open", "", " \n", None, "Why? ", "a\x0b", "é.\n", "x" * 50 + "."]
    out = []
    for k in range(n):
        turn = None if rng.random() < 0.05 else rng.randrange(max(1, n)) if rng.random() < 0.2 else k
        role = ("user", "assistant")[k % 2] if rng.random() < 0.6 else rng.choice(roles)
        text = f"turn {k}." if rng.random() < 0.6 else rng.choice(texts)
        out.append((conv, turn, role, text, rng.choice([1, 1, 1, 1, 1, 2, 0])))
    return out


def test_search():
    rng = random.Random(11)
    for _ in range(400):
        turns = [(rng.choice("suauaux"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(12))]
        assert repair.search(turns, 0) == cheapest(tuple(turns))


def test_conversations(spark):
    rng = random.Random(2)
    rows = [r for c in range(150) for r in conversation(rng, c if c != 7 else None, rng.randrange(1, 9))]
    rows += rows[:40]
    check(spark, rows)


@pytest.mark.parametrize("limit", [3, 40])
def test_one_conversation_over_many_tasks(spark, monkeypatch, limit):
    """A third of all rows in one conversation, cut into blocks and spread over partitions; many turns without number."""
    rng = random.Random(limit)
    rows = [r for c in range(30) for r in conversation(rng, c, 4)] + conversation(rng, 12, 90)
    rows += [(5, None, "user", f"same {i % 3}.", 1) for i in range(30)]
    monkeypatch.setattr(repair, "BLOCK_TURNS", limit)
    monkeypatch.setattr(repair, "_within", _small_blocks(limit))
    check(spark, rows)


def _small_blocks(limit):
    within = repair._within

    def run(batches, turns):
        repair.BLOCK_TURNS = limit  # in the worker
        try:
            yield from within(batches, turns)
        finally:
            repair.BLOCK_TURNS = 256

    return run


def test_repaired_turns(spark):
    rng = random.Random(4)
    rows = [r for c in range(40) for r in conversation(rng, c, 6)]
    turns = {}
    for r in sorted(repair.repaired_turns(frame(spark, rows)).collect(), key=lambda r: (r.conv_id, r.position)):
        assert r.position == len(turns.setdefault(r.conv_id, []))
        turns[r.conv_id].append((r.role, r.text, r.edit))
    for conv, want in by_hand(rows).items():
        made = turns.get(conv, [])
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b, _ in made).encode()).hexdigest() == want[-1]
        assert "".join(e for _, _, e in made) == want[-2].replace("D", "")


def test_empty_and_dropped(spark):
    assert repair.repair(frame(spark, [])).count() == 0
    only = repair.repair(frame(spark, [(3, 1, "user", "a.", 0), (3, 2, None, None, 0)])).collect()
    assert [tuple(r) for r in only] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    far = [(1, -(2**63), "user", "a.", 1), (1, 2**63 - 1, "assistant", "b.", 1), (2, 0, "user", "y" * 300_000, 1)]
    got = {r.conv_id: r for r in repair.repair(frame(spark, far)).collect()}
    assert got[1].gaps == 2**63 - 1 and (got[2].truncated, got[2].audit) == (1, "D")


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = []
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in r.text if c not in ".!?") if kind == 2 else r.text
        rows.append((r.conv_id, r.turn, "user" if kind == 4 else r.role, text, 0 if kind == 0 else 2 if kind == 3 else 1))
    got = queries.op12_repair(spark, folder).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == by_hand(rows)
