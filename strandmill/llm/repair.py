"""Repair of the structure of conversations by the cheapest edits, over time-major tensors.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``: nothing, or a system turn at most, and then
user and assistant in turns. Each row is kept, given another role or deleted; rows without text may be inserted
anywhere. Conversations stream in their order through tasks; those of about the same length are worked on together.
For each turn, from the last to the first, the least costs from each state of all these conversations are found at
once, and stored; then, from the first to the last, the edits of all are read off at once, the ASCII-least where some
cost the same.

A conversation of more than LONG rows or LONG_BYTES bytes is not held: its best edits up to each row are kept for each
state as the rows go by. Rows that repeat an earlier one are found by Spark beforehand, so nothing is remembered of
the rows of a conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a conversation may have to be worked on with others; the rows that are worked on at once.
LONG, LONG_BYTES, TOGETHER = 1 << 14, 1 << 25, 1 << 16

#: White space: everything else is a character of a text.
SPACE = " \t\n\x0b\f\r"

REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5  # costs; CUT: of a truncated row that stays

# States: nothing yet, after system, after user, after assistant. What a turn of each initial (s, u, a) leads to, and
# what an inserted or another role leads to; NEVER where it may not stand.
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 4
AFTER = np.array([[SYSTEM, NEVER, NEVER, NEVER, NEVER], [USER, USER, NEVER, USER, NEVER], [NEVER, NEVER, ASSISTANT, NEVER, NEVER], [NEVER] * 5])
OTHER = np.array([USER, USER, ASSISTANT, USER, NEVER])
INITIALS = {"s": 0, "u": 1, "a": 2}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: What is left to pay at the end, by inserts alone.
END = np.array([0, 2 * INSERT, INSERT, 0])
FAR = 1 << 40

KEEP, FIXED, OUT, ADDED = b"KRDI"

REPAIRS = "conv_id {}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, turns array<struct<role:string,text:string>>"
DIGESTS = "conv_id {}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def cheapest(initial: np.ndarray, must_go: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(costs, edits) of conversations of the same padded length, time first: (turns, conversations) arrays.

    ``initial``: 0, 1 and 2 for s, u and a, 3 for others, -1 beyond a conversation's end. ``edits``: (turns + 1, 3,
    conversations) of letters, 0 where there is none: two inserts before a row and what is done with it.
    """
    turns, n = initial.shape
    costs = np.empty((turns + 1, 5, n), np.int64)  # the stored backward costs; state NEVER costs FAR
    costs[turns, :4], costs[turns, 4] = END[:, None], FAR
    stay = np.where(cut, CUT, 0)
    for t in range(turns - 1, -1, -1):
        after, now = costs[t + 1], costs[t]
        beyond = initial[t] < 0
        kind = np.where(beyond, 3, initial[t])
        keep = np.take_along_axis(after, AFTER[kind].T, 0) + stay[t]
        keep[:, must_go[t]] = FAR
        other = after[OTHER[:4]] + REROLE + stay[t]
        other[:, must_go[t]] = FAR
        now[:4] = np.minimum(np.minimum(keep[:4], other), after[:4] + DELETE)
        now[USER], now[ASSISTANT] = np.minimum(now[USER], now[ASSISTANT] + INSERT), np.minimum(now[ASSISTANT], now[USER] + INSERT)
        now[:2] = np.minimum(now[:2], now[USER] + INSERT)
        now[:4, beyond], now[4] = after[:4, beyond], FAR
    edits = np.zeros((turns + 1, 3, n), np.uint8)
    state, every = np.full(n, START), np.arange(n)
    for t in range(turns + 1):
        now = costs[t]
        if t < turns:
            after, beyond, go = costs[t + 1], initial[t] < 0, must_go[t]
            kind = np.where(beyond, 3, initial[t])
        else:
            beyond = np.ones(n, bool)
        # Deletions come first in the order of letters, then inserts; two inserts at most can be cheapest.
        for k in range(2):
            open_ = now[state, every] == now[OTHER[state], every] + INSERT
            if t < turns:
                open_ &= ~beyond & (now[state, every] != after[state, every] + DELETE)
            edits[t, k, open_] = ADDED
            state = np.where(open_, OTHER[state], state)
        if t == turns:
            break
        left = now[state, every]
        out = after[state, every] + DELETE == left
        kept = AFTER[kind, state]
        keep = ~out & ~go & (after[kept, every] + stay[t] == left)
        edits[t, 2] = np.where(beyond, 0, np.where(out, OUT, np.where(keep, KEEP, FIXED)))
        state = np.where(beyond | out, state, np.where(keep, kept, OTHER[state]))
    return costs[0, START], edits


class Running:
    """A conversation that is too long to be held: for each state its cheapest edits so far, and what they give."""

    def __init__(self):
        #: Cost, audit, digest and whether that has a line, by state, in the order of the audits.
        self.best: dict[int, tuple] = {START: (0, bytearray(), sha256(), False)}

    def _begun(self) -> Iterator[tuple[int, int, int, bytes, list[str]]]:
        """(state, cost, state before, letters, lines) of each state, with as many inserts as can be cheapest."""
        for before, (cost, *_) in self.best.items():
            state, lines = before, []
            for k in range(3):
                yield state, cost + k * INSERT, before, b"I" * k, lines
                state = int(OTHER[state])
                lines = [*lines, f"{NAMES[state]}:"]

    def _ahead(self, ways: list[tuple]) -> None:
        """The best way to each state; equal costs go by the audit before, then by the letters."""
        rank, found = {s: i for i, s in enumerate(self.best)}, {}
        for state, cost, before, letters, lines in ways:
            key = cost, rank[before], letters
            if state not in found or key < found[state][0]:
                found[state] = key, before, lines
        uses = [before for _, before, _ in found.values()]
        old, self.best = self.best, {}
        for state, ((cost, _, letters), before, lines) in sorted(found.items(), key=lambda f: f[1][0][1:]):
            _, audit, digest, some = old[before]
            uses.remove(before)
            if before in uses:  # another state goes on from here too
                audit, digest = bytearray(audit), digest.copy()
            for line in lines:
                digest.update((f"\n{line}" if some else line).encode())
                some = True
            audit += letters
            self.best[state] = cost, audit, digest, some

    def add(self, role: str, text: str, must_go: bool, cut: bool) -> None:
        stay, ways = CUT if cut else 0, []
        for state, cost, before, letters, lines in self._begun():
            ways.append((state, cost + DELETE, before, letters + b"D", lines))
            if not must_go:
                kept, other = int(AFTER[INITIALS.get(role[:1], 3), state]), int(OTHER[state])
                if kept != NEVER:
                    ways.append((kept, cost + stay, before, letters + b"K", [*lines, f"{role}:{text}"]))
                ways.append((other, cost + REROLE + stay, before, letters + b"R", [*lines, f"{NAMES[other]}:{text}"]))
        self._ahead(ways)

    def end(self) -> tuple[int, str, str]:
        self._ahead([w for w in self._begun() if w[0] in (START, ASSISTANT)])
        rank = list(self.best)
        cost, audit, digest, _ = min((self.best[s] for s in rank), key=lambda b: (b[0], bytes(b[1])))
        return cost, audit.decode(), digest.hexdigest()


class Counts:
    """The faults of one conversation, row by row in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.last = None

    def add(self, turn: int | None, role: str, fault: str | None) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.last is not None:
            self.illegal += self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]

    def row(self) -> tuple[int, ...]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return min(gaps, (1 << 63) - 1), self.blank, self.duplicate, self.truncated, self.illegal


def _padded(lengths: list[int]) -> Iterator[list[int]]:
    """Conversations of about the same length, as runs of their places; the padding is a quarter at most."""
    order, begin = np.argsort(lengths, kind="stable").tolist(), 0
    for i in range(1, len(order) + 1):
        if i == len(order) or 4 * lengths[order[i]] > 5 * lengths[order[begin]] + 4 or (i - begin) * lengths[order[i]] > TOGETHER:
            yield order[begin:i]
            begin = i


def repaired_together(rows: list[list[tuple]]) -> list[tuple[int, str, list[tuple[str, str]]]]:
    """(cost, audit, turns) of each conversation; a row is (role, text, fault)."""
    out: list = [None] * len(rows)
    for some in _padded([len(r) for r in rows]):
        longest = len(rows[some[-1]])
        initial, go, cut = np.full((longest, len(some)), -1), np.zeros((longest, len(some)), bool), np.zeros((longest, len(some)), bool)
        for j, i in enumerate(some):
            own = rows[i]
            initial[: len(own), j] = [INITIALS.get(r[:1], 3) for r, _, _ in own]
            go[: len(own), j] = [f in ("blank", "duplicate") for _, _, f in own]
            cut[: len(own), j] = [f == "truncated" for _, _, f in own]
        costs, edits = cheapest(initial, go, cut)
        flat = np.ascontiguousarray(edits.transpose(2, 0, 1))
        for j, i in enumerate(some):
            turns, state, at = [], START, 0
            audit = flat[j].ravel()
            audit = audit[audit > 0].tobytes()
            for letter in audit:
                if letter == ADDED:
                    state = int(OTHER[state])
                    turns.append((NAMES[state], ""))
                    continue
                role, text, _ = rows[i][at]
                at += 1
                if letter == KEEP:
                    state = int(AFTER[INITIALS[role[:1]], state])
                    turns.append((role, text))
                elif letter == FIXED:
                    state = int(OTHER[state])
                    turns.append((NAMES[state], text))
            out[i] = int(costs[j]), audit.decode(), turns
    return out


def marked(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, gone, fault) of (conv_id, turn, role, text) rows; ``gone``: rows that are not there any more.

    Nulls in role and text count as one space. ``fault`` is the first of ``blank`` (no character but white space),
    ``duplicate`` (a row of the same role and text stands before it, by turn, null first) and ``truncated`` (the last
    character but white space is none of . ! ?); rows that are ``gone`` have none and count for none.
    """
    gone = F.coalesce(F.lit(False) if gone is None else gone, F.lit(False))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    rows = rows.repartition("conv_id")  # serves the window below and the repair
    stripped = F.rtrim("text", F.lit(SPACE))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("gone"), None).when(stripped == "", "blank").when(seen > 1, "duplicate").when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.withColumn("fault", fault)


def repair(rows: DataFrame, *, gone: Column | None = None, digest: bool = False, long_rows: int = LONG, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns) of each conversation of (conv_id, turn, role, text).

    A conversation's rows are taken by turn, nulls first; rows of the same turn by role and text. ``gaps``: the
    greatest turn less the least, plus 1, less the distinct ones, nulls aside. The faults: see ``marked``; each row
    counts for its first. ``illegal``: neighbours whose roles' initials are not su, ua or au. Keeping a row costs 0,
    another role 1, deleting it 2, which blank and duplicate rows need, a truncated row that stays 5, an inserted
    row 5. ``audit``: the initials of the cheapest edits in order (Keep, Rerole, Delete, Insert), ``turns`` what they
    give; with ``digest``, ``repaired_sha256`` instead: SHA-256 of the ``role:text`` of these, joined by line ends.

    A null conv_id is a conversation of its own. An empty role has no initial and cannot be kept. A conversation whose
    rows are all ``gone`` has zeros, an empty audit and no turns. ``turns`` is null for a
    conversation of more than ``long_rows`` rows or ``long_bytes`` bytes, which is not held; all else is as for others.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    lines = marked(rows, gone).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == "duplicate")

    def finish(names: list, counts: list[Counts], answers: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*(c.row() for c in counts)))
        cost, audit, result = zip(*answers)
        last = pa.array(result, pa.string() if digest else pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
        return pa.RecordBatch.from_arrays([pa.array(names, id_type), *(pa.array(c, pa.int64()) for c in columns), pa.array(cost, pa.int64()), pa.array(audit), last], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256" if digest else "turns"])

    def result(answer: tuple[int, str, list]) -> tuple:
        cost, audit, turns = answer
        if digest:
            return cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        return cost, audit, [{"role": r, "text": t} for r, t in turns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, held, total, size = [], [], [], 0, 0
        running, id_type, begun, at, bytes_ = None, None, False, None, 0

        def together() -> pa.RecordBatch:
            nonlocal names, counts, held, total, size
            out = finish(names, counts, [result(a) for a in repaired_together(held)], id_type)
            names, counts, held, total, size = [], [], [], 0, 0
            return out

        def ended() -> Iterator[pa.RecordBatch]:
            """The conversation that was too long to be held, if it is one."""
            nonlocal running
            if running is not None:
                cost, audit, sha = running.end()
                yield finish([names.pop()], [counts.pop()], [(cost, audit, sha if digest else None)], id_type)
                held.pop()
                running = None

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, turn, role, text, gone, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault"))):
                if not begun or conv != at:
                    yield from ended()
                    if total > TOGETHER or size > LONG_BYTES:
                        yield together()
                    begun, at, bytes_ = True, conv, 0
                    names.append(conv)
                    counts.append(Counts())
                    held.append([])
                if gone:
                    continue
                counts[-1].add(turn, role, fault)
                if running is None:
                    held[-1].append((role, text, fault))
                    total, size, bytes_ = total + 1, size + len(text), bytes_ + len(text)
                    if len(held[-1]) > long_rows or bytes_ > long_bytes:
                        running, total, size = Running(), total - len(held[-1]), size - bytes_
                        for r, t, f in held[-1]:
                            running.add(r, t, f in ("blank", "duplicate"), f == "truncated")
                        held[-1] = []
                else:
                    running.add(role, text, fault in ("blank", "duplicate"), fault == "truncated")
        yield from ended()
        if names:
            yield together()

    return lines.mapInArrow(run, (DIGESTS if digest else REPAIRS).format(kind))


def tampered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): conversations damaged by rule, for tests of ``repair``.

    By crc32 of ``conv_id:turn`` modulo 20, nulls being one space: 0 drops a row (it stays as ``gone``), 1 empties its text, 2 takes
    its . ! ? away, 3 repeats it, 4 makes it the user's.
    """
    blank = F.lit(" ")
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), times.alias("copy")).drop("copy")
