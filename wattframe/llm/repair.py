"""Repair of conversation structure: the cheapest edits that make roles alternate, found by iterative deepening."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .batches import bounded

BLANKS = " \t\n\x0b\f\r"
#: Costs of the edits (fixed values). A truncated turn that stays costs ``TRUNCATED`` more.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Turns and characters that are searched at a time; a longer conversation is cut into blocks.
BLOCK_TURNS, BLOCK_CHARS = 256, 4_000_000

#: What comes last in the repaired roles so far: nothing, a system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
_NEXT_ROLE = ("user", "user", "assistant", "user")
_AFTER = (USER, USER, ASSISTANT, USER)
_ENDS = (NOTHING, ASSISTANT)
_NEVER = 1 << 60
#: Faults of a turn.
FINE, BLANK, DUPLICATE, CUT = range(4)
SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


# ---- the search ----


def keeps(initial: str, state: int) -> int | None:
    """State after a turn with that role initial, if it may follow."""
    if initial == "s" and state == NOTHING:
        return SYSTEM
    if initial == "u" and state != USER:
        return USER
    if initial == "a" and state == USER:
        return ASSISTANT
    return None


def search(turns: list[tuple[str, int]], start: int, goal: int | None = None) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits from state ``start``, the least audit in ASCII order among them.

    ``turns`` has each turn's role initial and fault. With a ``goal`` the last edit is one of a turn and leads to
    that state; without, all is accepted that the rules accept, and turns may be inserted at the end.

    Iterative-deepening A*: depth-first in the order D, I, K, R within a bound on the cost, which rises to the least
    that can't be ruled out. ``least[state]`` is the table of failed states: what is still to be paid from there
    was shown to be so much at least, first by the turns' own faults, then by every search that failed.
    """
    n = len(turns)
    own = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        initial, fault = turns[i]
        own[i] = own[i + 1] + (DELETE if fault else 0 if initial in ("s", "u", "a") else min(DELETE, REROLE))
    least = [own[i] for i in range(n + 1) for _ in STATES]
    if goal is not None:
        least[4 * n :] = [0 if state == goal else _NEVER for state in STATES]
        if goal in (NOTHING, SYSTEM):  # a turn after the first system turn never leads back
            system = False
            for i in range(n, -1, -1):
                system = system or (i < n and turns[i][0] == "s" and turns[i][1] in (FINE, CUT))
                for state in STATES:
                    if state != goal and not (goal == SYSTEM and state == NOTHING and system):
                        least[4 * i + state] = _NEVER
    else:
        least[4 * n + SYSTEM], least[4 * n + USER] = 2 * INSERT, INSERT

    def moves(i, state):
        if i < n:
            initial, fault = turns[i]
            yield DELETE, i + 1, state, "D"
            yield INSERT, i, _AFTER[state], "I"
            if fault in (FINE, CUT):
                extra = TRUNCATED if fault == CUT else 0
                after = keeps(initial, state)
                if after is not None:
                    yield extra, i + 1, after, "K"
                yield REROLE + extra, i + 1, _AFTER[state], "R"
        elif goal is None:
            yield INSERT, i, _AFTER[state], "I"

    def done(i, state):
        return i == n and (state == goal if goal is not None else state in _ENDS)

    first = start
    while least[first] < _NEVER:
        bound = least[first]
        if done(0, start):
            return 0, ""
        stack = [[0, start, bound, moves(0, start), _NEVER, ""]]
        while stack:
            i, state, rest, todo, best, _ = frame = stack[-1]
            for price, j, after, letter in todo:
                needed = least[4 * j + after]
                if price + needed > rest:
                    if price + needed < frame[4]:
                        frame[4] = price + needed
                    continue
                if done(j, after):
                    return bound - rest + price, "".join(f[5] for f in stack) + letter
                stack.append([j, after, rest - price, moves(j, after), _NEVER, letter])
                break
            else:
                stack.pop()
                place = 4 * i + state
                least[place] = max(least[place], frame[4])
                if stack:
                    above = stack[-1]
                    spent = above[2] - rest
                    above[4] = min(above[4], spent + least[place])
    return None


def edited(turns: list[tuple[str, str, int]], audit: str, state: int) -> Iterator[tuple[str, str, str, int]]:
    """Role, text, edit and following state of every turn that the edits leave."""
    at = 0
    for letter in audit:
        role, text, _ = turns[at] if letter != "I" else ("", "", FINE)
        at += letter != "I"
        if letter == "D":
            continue
        if letter == "K":
            state = keeps(role[:1], state)
        else:
            role, state = _NEXT_ROLE[state], _AFTER[state]
        yield role, text, letter, state


# ---- conversations as streams of ordered turns ----


class _Block:
    """A run of a conversation's turns, and what their order tells."""

    def __init__(self):
        self.turns: list[tuple[str, str, int]] = []
        self.chars = 0
        self.faults = [0, 0, 0, 0]
        self.illegal = self.distinct = 0
        self.low = self.high = self.last_turn = None

    def add(self, turn, role, text, fault):
        if self.turns:
            self.illegal += self.turns[-1][0][:1] + role[:1] not in ("su", "ua", "au")
        self.turns.append((role, text, fault))
        self.chars += len(role) + len(text)
        self.faults[fault] += 1
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.distinct += turn != self.last_turn
            self.high = self.last_turn = turn

    def full(self):
        return len(self.turns) >= BLOCK_TURNS or self.chars >= BLOCK_CHARS

    def marks(self):
        return [(role[:1], fault) for role, _, fault in self.turns]


class _Whole:
    """What is known of a conversation after some of its blocks."""

    def __init__(self):
        self.state, self.cost, self.n = NOTHING, 0, 0
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = None
        self.last = ""
        self.any = False

    def add(self, block: dict, audit: str, price: int) -> list[tuple]:
        """Take the block's turns with these edits; returns the turns that they leave."""
        kept = []
        for role, text, letter, state in edited(block["turns"], audit, self.state):
            if self.n:
                self.hash.update(b"\n")
            self.hash.update(f"{role}:{text}".encode())
            kept.append((self.n, role, text, letter))
            self.n += 1
            self.state = state
        self.cost += price
        self.audit.append(audit)
        if block["turns"]:
            faults = block["faults"]
            self.blank, self.duplicate = self.blank + faults[BLANK], self.duplicate + faults[DUPLICATE]
            self.truncated += faults[CUT]
            first, last = block["turns"][0][0][:1], block["turns"][-1][0][:1]
            self.illegal += block["illegal"] + (self.any and self.last + first not in ("su", "ua", "au"))
            self.last, self.any = last, True
        if block["low"] is not None:
            self.distinct += block["distinct"] - (block["low"] == self.high)
            self.low = block["low"] if self.low is None else self.low
            self.high = block["high"]
        return kept

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, 2**63 - 1)
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit),
                self.hash.hexdigest())


def _as_dict(block: _Block) -> dict:
    return {"turns": block.turns, "faults": block.faults, "illegal": block.illegal, "distinct": block.distinct,
            "low": block.low, "high": block.high}


_TURN = pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.int8())])
_BLOCK = pa.struct([
    ("turns", pa.list_(_TURN)), ("faults", pa.list_(pa.int64())), ("illegal", pa.int64()), ("distinct", pa.int64()),
    ("low", pa.int64()), ("high", pa.int64()), ("costs", pa.list_(pa.int64())),
])
_BLOCK_DDL = ("block struct<turns array<struct<role string, text string, fault tinyint>>, faults array<bigint>, illegal bigint, "
              "distinct bigint, low bigint, high bigint, costs array<bigint>>")
_SUMMARY_DDL = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'bigint'}" for c in SUMMARY)
_SUMMARY = [(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in SUMMARY]
_KEPT = [("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]


class _Out:
    """Rows for Spark, in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def put(self, row: tuple, size: int = 100) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size >= 2_000_000:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = list(zip(*self.rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.size = [], 0


def _id_type(batches) -> tuple[pa.DataType, Iterator[pa.RecordBatch]]:
    batches = iter(batches)
    head = list(itertools.islice(batches, 1))
    return head[0].schema.field("conv_id").type if head else pa.int64(), itertools.chain(head, batches)


def _stream(batches, *columns) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))


def _blocks_of(batches) -> Iterator[tuple]:
    """``conv, block, first, last``: runs of the turns of one conversation after the other in a sorted partition."""
    now, block, first, any_ = None, None, True, False
    for conv, turn, role, text, copies, again, blank, cut in _stream(
            batches, "conv_id", "turn", "role", "text", "copies", "again", "blank", "cut"):
        if any_ and conv != now:
            yield now, block, first, True
            first = True
        if not any_ or conv != now:
            now, block, any_ = conv, _Block(), True
        for k in range(copies):
            if block.full():
                yield now, block, first, False
                block, first = _Block(), False
            fault = BLANK if blank else DUPLICATE if again or k else CUT if cut else FINE
            block.add(turn, role, text, fault)
    if any_:
        yield now, block, first, True


def _within(batches, turns: bool):
    """Repair what lies whole in this partition; hand on the blocks of what may go on in another.

    The partition's first and last conversations may have turns in the partitions beside it.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    id_type, batches = _id_type(batches)
    kind = _KEPT if turns else _SUMMARY
    out = _Out(pa.schema([("conv_id", id_type), ("part", pa.int32()), ("seq", pa.int64()), ("block", _BLOCK), *kind]))
    nothing = (None,) * len(kind)

    def hand_on(conv, seq, block):
        found = [search(block.marks(), a, b) if block.turns else (0, "") if a == b else None for a in STATES for b in STATES]
        costs = [_NEVER if f is None else f[0] for f in found]
        return out.put((conv, part, seq, _as_dict(block) | {"costs": costs}, *nothing), block.chars + 1000)

    seq, waiting, at_start = 0, None, True
    for conv, block, first, last in _blocks_of(batches):
        if waiting is not None:  # a whole conversation with another one after it
            yield from _finish(out, *waiting, turns)
            waiting = None
        if first and last and not at_start:
            waiting = conv, block
        else:
            yield from hand_on(conv, seq, block)
            seq += 1
        at_start = at_start and not last
    if waiting is not None:
        yield from hand_on(waiting[0], seq, waiting[1])
    yield from out.rest()


def _finish(out: _Out, conv, block: _Block, turns: bool):
    whole = _Whole()
    price, audit = search(block.marks(), NOTHING)
    kept = whole.add(_as_dict(block), audit, price)
    if turns:
        for row in kept:
            yield from out.put((conv, None, None, None, *row), 50 + len(row[2]))
    else:
        yield from out.put((conv, None, None, None, *whole.summary()), 300 + len(audit))


def _to_go(batches):
    """For every block what the edits after it cost at least, from each state at its end."""
    id_type, batches = _id_type(batches)
    out = _Out(pa.schema([("conv_id", id_type), ("part", pa.int32()), ("seq", pa.int64()), ("to_go", pa.list_(pa.int64()))]))

    def close(conv, blocks):
        go = [0, 2 * INSERT, INSERT, 0]
        for part, seq, costs in reversed(blocks):
            yield from out.put((conv, part, seq, go))
            go = [min(costs[4 * a + b] + go[b] for b in STATES) for a in STATES]

    now, blocks, any_ = None, [], False
    for conv, part, seq, costs in _stream(batches, "conv_id", "part", "seq", "costs"):
        if any_ and conv != now:
            yield from close(now, blocks)
            blocks = []
        now, any_ = conv, True
        blocks.append((part, seq, costs))
    if any_:
        yield from close(now, blocks)
    yield from out.rest()


def _across(batches, turns: bool):
    """Go through the blocks of each conversation in order, with the state and the hash so far."""
    id_type, batches = _id_type(batches)
    out = _Out(pa.schema([("conv_id", id_type), *(_KEPT if turns else _SUMMARY)]))
    empty = {"turns": [], "faults": [0] * 4, "illegal": 0, "distinct": 0, "low": None, "high": None}

    def put(conv, kept):
        if turns:
            for row in kept:
                yield from out.put((conv, *row), 50 + len(row[2]))

    def close(conv, whole):
        price, audit = search([], whole.state)
        yield from put(conv, whole.add(empty, audit, price))
        if not turns:
            summary = whole.summary()
            yield from out.put((conv, *summary), 300 + len(summary[-2]))

    now, whole = None, None
    for conv, block, go in _stream(batches, "conv_id", "block", "to_go"):
        if whole is None or conv != now:
            if whole is not None:
                yield from close(now, whole)
            now, whole = conv, _Whole()
        block["turns"] = [(t["role"], t["text"], t["fault"]) for t in block["turns"]]
        if not block["turns"]:
            whole.add(block, "", 0)
            continue
        row = [block["costs"][4 * whole.state + b] + go[b] for b in STATES]
        marks = [(role[:1], fault) for role, _, fault in block["turns"]]
        # audits of one block end with a turn, so none is the beginning of another: the least one is the answer's
        audit, price = min(search(marks, whole.state, b)[::-1] for b in STATES if row[b] == min(row))
        yield from put(conv, whole.add(block, audit, price))
    if whole is not None:
        yield from close(now, whole)
    yield from out.rest()


# ---- on Spark ----


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` with faults by a checksum of conversation and turn; nulls are one space.

    Of twenty turns one is dropped (no copies), one loses its text, one its full stops, one is there twice, and one
    is the user's.
    """
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(F.encode(named, "UTF-8")) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _judged(rows: DataFrame) -> DataFrame:
    """Rows that are alike as one row with their number, and each one's faults."""
    gone = F.col("copies") <= 0
    rows = rows.select(
        "conv_id", F.when(~gone, F.col("turn").cast("bigint")).alias("turn"),
        F.when(gone, "").otherwise(F.coalesce("role", F.lit(""))).alias("role"),
        F.when(gone, "").otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.greatest(F.col("copies"), F.lit(0)).alias("copies"),
    )
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    rows = cut_lineage(rows.withColumn("_said", said))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = rows.where("copies > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("_said").alias("_what")).agg(
        F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_what"))
    rows = rows.join(firsts, same, "left")
    ending = F.rtrim(F.col("text"), F.lit(BLANKS))
    return rows.select(
        "conv_id", "turn", "role", "text", "copies", F.coalesce(place > F.col("_first"), F.lit(False)).alias("again"),
        (ending == "").alias("blank"), (~F.right(ending, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )


def _repair(rows: DataFrame, turns: bool) -> DataFrame:
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1))
    id_ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    kind = "position bigint, role string, text string, edit string" if turns else _SUMMARY_DDL
    names = [c.split()[0] for c in kind.split(", ")]

    ordered = _judged(rows).repartitionByRange(
        "conv_id", "turn", F.substring("role", 1, 16).alias("_r"), F.substring("text", 1, 32).alias("_t"))
    ordered = bounded(ordered.sortWithinPartitions("conv_id", "turn", "role", "text"))
    done = cut_lineage(ordered.mapInArrow(functools.partial(_within, turns=turns),
                                          f"{id_ddl}, part int, seq bigint, {_BLOCK_DDL}, {kind}"))

    open_ = done.where("part IS NOT NULL")
    costs = open_.select("conv_id", "part", "seq", F.col("block.costs").alias("costs"))
    costs = costs.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    go = costs.mapInArrow(_to_go, f"{id_ddl}, part int, seq bigint, to_go array<bigint>")
    go = go.drop("conv_id")
    blocks = open_.join(go, ["part", "seq"]).select("conv_id", "part", "seq", "block", "to_go")
    blocks = bounded(blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq"))
    rest = blocks.mapInArrow(functools.partial(_across, turns=turns), f"{id_ddl}, {kind}")
    return done.where("part IS NULL").select("conv_id", *names).unionByName(rest)


def repair(rows: DataFrame) -> DataFrame:
    """Each conversation's faults and cheapest edits: ``conv_id`` and the columns of ``SUMMARY``.

    ``rows`` has ``conv_id, turn, role, text``, and ``copies`` if a row stands for several (none: the row only names
    its conversation). Turns are taken by ``turn``, nulls first, ties by role and text. A turn is blank without any
    character but ASCII blanks, a duplicate if role and text were there before, truncated if its last such character
    ends no sentence; the first of these counts. ``audit`` has an initial for each edit: delete, insert, keep,
    rerole. The edits are those of :func:`search`. A null role or text is empty; a role without ``s``, ``u`` or ``a``
    as its initial can't be kept. A null ``conv_id`` is a conversation; rows that are alike are all there. A
    conversation without turns has zeros, an empty audit and the hash of nothing; an empty table has no rows. Other
    columns don't matter.

    All turns are sorted by range, so a conversation with a third of all rows is spread over tasks. What lies in one
    task is repaired there; the rest is cut into blocks of ``BLOCK_TURNS``, of which the costs between any two
    states are found where they lie, the costs to go are added up from the end with 16 numbers a block, and the
    edits are settled in order. That last step hashes a conversation's text from its beginning, as SHA-256 must,
    and holds one block at a time.
    """
    return _repair(rows, False)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, position, role, text, edit``: the turns that the edits of :func:`repair` leave, from position 0."""
    return _repair(rows, True)
