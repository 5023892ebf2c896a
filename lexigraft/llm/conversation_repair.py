"""Repairing the structure of conversations with the cheapest edits.

Messages are judged and numbered by sorting, solved per conversation from one byte a message, and edited in a second
sorted pass that streams their texts. The search is a depth-first branch and bound.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraft.llm.common import Memory
from lexigraft.session import materialize

#: Costs of edits, and of a truncated message that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Faults of a message.
NONE, BLANK, DUPLICATE, CUT = range(4)
#: Where the repaired conversation stands: nothing yet, after the system message, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a new message makes of each place: a user's message everywhere but after a user's.
FOLLOWING = (USER, USER, ASSISTANT, USER)
#: Bits of a message's code: its role's initial (0: another) below, then whether it must go and whether it is truncated.
ROLES, MUST_GO, IS_CUT = 3, 4, 8
#: White space.
BLANKS = " \t\n\x0b\x0c\r"
#: Conversations up to this long are remembered by their codes.
REMEMBERED_LENGTH, REMEMBERED = 64, 50_000

NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
REGULAR = {"su", "ua", "au"}
_FAR = 1 << 30


def suffix_bounds(codes: bytes) -> array:
    """For every place before a message and every state, ``4 * place + state``: what the rest costs at least.

    Counted from the end, of costs alone: which of several equally dear completions is chosen is left open.
    """
    n = len(codes)
    bounds = array("i", bytes(16 * (n + 1)))
    start, system, user, assistant = 0, 2 * INSERT, INSERT, 0
    bounds[4 * n : 4 * n + 4] = array("i", [start, system, user, assistant])
    for i in range(n - 1, -1, -1):
        code = codes[i]
        next_start, next_system, next_user, next_assistant = start, system, user, assistant
        start, system, user, assistant = start + DELETE, system + DELETE, user + DELETE, assistant + DELETE
        if not code & MUST_GO:
            role, extra = code & ROLES, TRUNCATED if code & IS_CUT else 0
            to_user = next_user + extra + (KEEP if role == USER else REROLE)
            to_assistant = next_assistant + extra + (KEEP if role == ASSISTANT else REROLE)
            start, system, assistant = min(start, to_user), min(system, to_user), min(assistant, to_user)
            user = min(user, to_assistant)
            if role == SYSTEM:
                start = min(start, next_system + extra + KEEP)
        # New messages before this one; more than two in a row lead nowhere new.
        user = min(user, INSERT + assistant)
        assistant = min(assistant, INSERT + user)
        start, system = min(start, INSERT + user), min(system, INSERT + user)
        bounds[4 * i : 4 * i + 4] = array("i", [start, system, user, assistant])
    return bounds


def solve(codes: bytes) -> tuple[int, str]:
    """The least cost of edits after which the roles read ``(s?(ua)+)?``, and the ASCII-least such edits.

    Depth-first branch and bound with an explicit stack. Edits are tried in the order of their letters, so prefixes
    reach a node (message, state) in ASCII order: one that is not cheaper than an earlier one there is worse, and so
    is a whole repair that is not cheaper than the incumbent. Nodes whose cost and suffix bound exceed the incumbent's
    cost, at first the bound of the whole, are cut. An empty stack proves the incumbent.
    """
    n = len(codes)
    bounds = suffix_bounds(codes)
    best_cost, best_link = bounds[START], -1
    dominating = array("i", [_FAR]) * (4 * (n + 1))
    parents, letters = array("i"), bytearray()
    stack = [(START, 0, -1, 0)]
    found = False
    while stack:
        node, cost, parent, letter = stack.pop()
        bound = cost + bounds[node]
        if bound > best_cost or (found and bound == best_cost) or cost >= dominating[node]:
            continue
        dominating[node] = cost
        link = len(parents)
        parents.append(parent)
        letters.append(letter)
        i, state = node >> 2, node & 3
        if i == n and state in (START, ASSISTANT):
            best_cost, best_link, found = cost, link, True
            continue
        inserted = (node & ~3) | FOLLOWING[state]
        if i == n:
            stack.append((inserted, cost + INSERT, link, 73))
            continue
        code, below = codes[i], (i + 1) << 2
        # The last pushed is tried first: D, I, K, R.
        if not code & MUST_GO:
            role, extra = code & ROLES, TRUNCATED if code & IS_CUT else 0
            stack.append((below | FOLLOWING[state], cost + REROLE + extra, link, 82))
            if role and role == (SYSTEM if state == START and role == SYSTEM else FOLLOWING[state]):
                stack.append((below | role, cost + KEEP + extra, link, 75))
        stack.append((inserted, cost + INSERT, link, 73))
        stack.append((below | state, cost + DELETE, link, 68))
    audit = bytearray()
    while best_link > 0:
        audit.append(letters[best_link])
        best_link = parents[best_link]
    return best_cost, audit[::-1].decode("ascii")


# Messages as Spark columns


def _shown(column: Column) -> Column:
    """A column's text, nulls as one space."""
    return F.coalesce(column.cast("string"), F.lit(" "))


def _messages(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv, turn, role, text, key)``; ``key`` orders texts of one turn and role, and tells them apart."""
    text = _shown(F.col(text_col))
    return rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        _shown(F.col(role_col)).alias("role"),
        text.alias("text"),
        F.unhex(F.md5(text)).alias("key"),
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]


class _Conversation:
    """What one pass over the messages of a conversation, in their order, counts."""

    def __init__(self):
        self.codes = bytearray()
        self.seen: set[tuple[str, bytes]] = set()
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, role: str, key: bytes, last_character: str) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.turns == 0 else self.first
            self.last, self.turns = turn, self.turns + 1
        if not last_character:
            fault = BLANK
        elif (role, key) in self.seen:
            fault = DUPLICATE
        else:
            fault = NONE if last_character in ".!?" else CUT
        self.seen.add((role, key))
        self.faults[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in REGULAR:
            self.illegal += 1
        self.before = initial
        code = INITIALS.get(initial, 0)
        self.codes.append(code | (MUST_GO if fault in (BLANK, DUPLICATE) else IS_CUT if fault == CUT else 0))

    def gaps(self) -> int:
        return self.last - self.first + 1 - self.turns if self.turns else 0


def _audits(messages: DataFrame, kind: str) -> DataFrame:
    """A row of counts, cost and audit per conversation, from narrow columns in sorted order."""
    ended = F.rtrim("text", F.lit(BLANKS))
    narrow = (
        messages.select("conv", "turn", "role", "key", F.right(ended, F.lit(1)).alias("ends"))
        .repartition("conv")
        .sortWithinPartitions(F.col("conv"), *_order())
    )
    schema = f"conv {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solved = Memory(solve, REMEMBERED)
        conv, current, done = None, None, []

        def close() -> None:
            codes = bytes(current.codes)
            cost, audit = solved[codes] if len(codes) <= REMEMBERED_LENGTH else solve(codes)
            done.append((conv, current.gaps(), *current.faults[1:], current.illegal, cost, audit))

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, arrow.field(i).type) for i, c in enumerate(zip(*done))]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            for name, *message in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or name != conv:
                    if current is not None:
                        close()
                    conv, current = name, _Conversation()
                current.add(*message)
            if done:
                yield out()
        if current is not None:
            close()
            yield out()

    arrow = _arrow(schema)
    return narrow.mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _edited(messages: DataFrame, audits: DataFrame) -> DataFrame:
    """Audits and messages of each conversation one after the other: ``(conv, audit, role, text)``, an audit first."""
    first = audits.select("conv", "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("key", "binary"))])
    rows = messages.select("conv", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "key")
    # Messages have a role, audits have not, so nulls first puts the audit before turns that are null.
    return (
        first.unionByName(rows)
        .repartition("conv")
        .sortWithinPartitions(F.col("conv"), F.col("audit").isNull(), *_order())
        .select("conv", "audit", "role", "text")
    )


def repaired(audit: str, messages: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """The edits of an audit that leave a message: (letter, role, text). ``messages`` are taken one by one."""
    state = START
    for letter in audit:
        if letter == "I":
            state = FOLLOWING[state]
            yield letter, NAMES[state], ""
            continue
        role, text = next(messages)
        if letter == "D":
            continue
        if letter == "R":
            state = FOLLOWING[state]
            role = NAMES[state]
        else:
            state = INITIALS[role[:1]]
        yield letter, role, text


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, audit, its repaired messages as an iterator) out of the rows of :func:`_edited`."""
    rows = _streamed(batches)
    for conv, audit, _, _ in rows:
        yield conv, repaired(audit, ((role, text) for _, _, role, text in rows))
        # All messages of the audit are consumed by whoever takes the repaired ones to their end.


TURN_ROWS = 5_000


def repair_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Counts of faults, and the cheapest edits, per conversation that has messages.

    Returns ``(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``. Messages are
    taken by turn, nulls first, those of one turn by role and text digest. A null role or text is one space; null
    conversations are one conversation; empty texts are blank; an empty table gives an empty one; other columns are
    ignored. The edits: keep (0), rerole to user or assistant (1), delete (2, a must for blank and repeated
    messages), insert an empty message (5); truncated messages that stay cost 5 more. The audit has their initials,
    the ASCII-least of the cheapest; the digest is of the repaired ``role:text`` joined by line feeds, as streamed,
    and equals that of :func:`repaired_turns`.

    A conversation is in one task, as its digest is one sequence, but never in memory: texts are streamed; held are
    16 bytes and a set entry per message while it is judged, and some 40 while it is solved.
    """
    kind = dict(rows.dtypes)[conv_col]
    messages = _messages(rows, conv_col, turn_col, role_col, text_col)
    audits = materialize(_audits(messages, kind), "audits")
    arrow = _arrow(f"conv {kind}, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for conv, turns in _conversations(batches):
            digest, between = hashlib.sha256(), ""
            for _, role, text in turns:
                digest.update(f"{between}{role}:{text}".encode("utf-8"))
                between = "\n"
            done.append((conv, digest.hexdigest()))
            if len(done) >= TURN_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow.types)], schema=arrow)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow.types)], schema=arrow)

    digests = _edited(messages, audits).mapInArrow(run, f"conv {kind}, repaired_sha256 string")
    counted = audits.withColumnRenamed("conv", "_conv")
    return digests.join(counted, F.col("conv").eqNullSafe(F.col("_conv"))).select(
        F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


def repaired_turns(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The messages of the repaired conversations: ``(conv_col, place BIGINT, edit, role, text)``, places from 0.

    As :func:`repair_conversations`; conversations of which nothing is left have no row.
    """
    kind = dict(rows.dtypes)[conv_col]
    messages = _messages(rows, conv_col, turn_col, role_col, text_col)
    audits = materialize(_audits(messages, kind), "audits")
    schema = f"`{conv_col}` {kind}, place bigint, edit string, role string, text string"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held = [], 0
        for conv, turns in _conversations(batches):
            for place, (edit, role, text) in enumerate(turns):
                done.append((conv, place, edit, role, text))
                held += len(text)
                if len(done) >= TURN_ROWS or held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow.types)], schema=arrow)
                    done, held = [], 0
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow.types)], schema=arrow)

    return _edited(messages, audits).mapInArrow(run, schema)
