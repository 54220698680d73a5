import heapq
import random
import re
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from strandmill.llm import queries, repair

WORDS, RIGHT = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"(s?(ua)+)?")
BEGUN = re.compile(r"s?(ua)*u?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = WORDS.findall(text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, insert=5, delete=2):
    """The cheapest edits by a search in the order of cost and letters, over whole sequences of roles."""
    marks, heap, done = faults(rows), [(0, "", 0, ())], set()
    while True:
        cost, audit, at, out = heapq.heappop(heap)
        names = "".join(r[:1] for r, _ in out)
        if at == len(rows) and RIGHT.fullmatch(names):
            return cost, audit, out
        if (at, names) in done:
            continue
        done.add((at, names))
        ways = [(insert, "I", at, (role, "")) for role in ("user", "assistant")] if len(out) < 2 * len(rows) + 4 else []
        if at < len(rows):
            _, role, text = rows[at]
            stay = 5 * (marks[at] == "truncated")
            ways.append((delete, "D", at + 1, None))
            if marks[at] not in ("blank", "duplicate"):
                ways += [(stay, "K", at + 1, (role, text))] * bool(role) + [(1 + stay, "R", at + 1, (r, text)) for r in ("user", "assistant")]
        for more, letter, then, turn in ways:
            new = (*out, turn) if turn else out
            if BEGUN.fullmatch("".join(r[:1] for r, _ in new)):
                heapq.heappush(heap, (cost + more, audit + letter, then, new))


def damage(rows):
    """The contract's damage, row by row, in plain Python."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    out = []
    for conv, own in rows.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, marks = [t for t, _, _ in own if t is not None], faults(own)
        cost, audit, result = cheapest(own)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = sha256("\n".join(f"{r}:{t}" for r, t in result).encode()).hexdigest()
        out.append((conv, gaps, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha))
    return sorted(out, key=repr)


def conversations(n=220, longest=9):
    rng, rows = random.Random(12), []
    texts = ["Yes.", "No!", "Why?", "and then", "a. b", " ", "", "\t\n", "ok.  \n", "…", "Long one. \x1f", None]
    for conv in [*range(n), None]:
        turns = rng.sample(range(-3, 40), rng.randrange(1, longest))
        for turn in (sorted(turns) if rng.random() < 0.7 else [rng.choice((None, *turns)) for _ in turns]):
            rows.append((conv, turn, rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown", "User")), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"long_rows": 0}, {"long_rows": 3}, {"long_bytes": 10}])
def test_repair_against_search(spark, limits):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, fault int").repartition(5)
    found = repair.repair(repair.tampered(frame), gone=F.col("gone"), digest=True, **limits)
    expected = brute(damage(rows))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected
    assert {c for r in expected for c in r[7]} == set("KRD")  # at these costs an insert is never the cheapest


@pytest.mark.parametrize("insert,delete", [(5, 2), (1, 3), (2, 4), (1, 1), (3, 3)])
def test_other_costs(monkeypatch, insert, delete):
    """Inserts too, held together and one by one, with ties of every kind."""
    for name, value in (("INSERT", insert), ("DELETE", delete), ("END", repair.np.array([0, 2 * insert, insert, 0]))):
        monkeypatch.setattr(repair, name, value)
    rng, rows = random.Random(insert * 10 + delete), []
    for _ in range(300):
        rows.append([(i, rng.choice(("user", "assistant", "system", "x")), rng.choice(("a.", "b.", "c", "d", " ", "e!"))) for i in range(rng.randrange(7))])
    marked = [[(r, t, f) for (_, r, t), f in zip(own, faults(own))] for own in rows]
    expected = [cheapest(own, insert, delete) for own in rows]
    assert [(c, a, tuple(t)) for c, a, t in repair.repaired_together(marked)] == expected
    assert insert >= 3 or any("I" in a for _, a, _ in expected)
    for own, (cost, audit, turns) in zip(marked, expected):
        running = repair.Running()
        for r, t, f in own:
            running.add(r, t, f in ("blank", "duplicate"), f == "truncated")
        assert running.end() == (cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())


def test_turns_and_undamaged_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "cut off"), (1, 4, "assistant", "Bye!"), (2, 0, "user", " "), (3, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in repair.repair(frame).collect()}
    _, audit, turns = cheapest([r[1:] for r in rows[:4]])
    assert found[1]["audit"] == audit and [tuple(t) for t in found[1]["turns"]] == list(turns)
    assert (found[1]["gaps"], found[1]["truncated"], found[1]["illegal"]) == (1, 1, 1)
    assert (found[2]["cost"], found[2]["audit"], found[2]["turns"], found[2]["blank"]) == (2, "D", [], 1)
    assert (found[3]["cost"], found[3]["gaps"], found[3]["blank"]) == (2, 0, 1)
    held = repair.repair(frame, long_rows=1).where("conv_id = 1").first()
    assert held["turns"] is None and held["audit"] == audit
    assert repair.repair(frame.where("false")).collect() == []


def test_long_conversations_agree(spark):
    """A conversation of many rows gives the same, held or not."""
    rows = [(r[0], i, r[2], f"{r[3] or ''} {i}{'.' if i % 7 else ''}") for i, r in enumerate(conversations(300, 14))]
    frame = spark.createDataFrame([(1, *r[1:]) for r in rows], "conv_id long, turn long, role string, text string").repartition(3)
    held, passed = (repair.repair(frame, digest=True, long_rows=n).collect() for n in (1 << 14, 2))
    assert held == passed and len(held[0]["audit"]) >= len(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op13_conversation_repair(spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(damage(rows))
