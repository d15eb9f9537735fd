"""Conversation repair against a search through all edits, whole and in chunks."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from factstore.llm import dialogue

MESSAGES = "conv_id bigint, turn bigint, role string, text string, copies string, chunk string"
WHITE = " \t\n\x0b\x0c\r"


def may_follow(initials):
    return re.fullmatch("s?(ua)*u?", initials) is not None


def cheapest(rows):
    """Faults and the cheapest edits of (turn, role, text), least audit first, by trying edits in order of cost."""
    faults, seen = "", set()
    for _, role, text in rows:
        bare = text.strip(WHITE)
        faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
        seen.add((role, text))
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return faults, cost, audit, lines
        steps = []
        if i < len(rows):
            _, role, text = rows[i]
            steps.append((3, "D", 1, "", ()))
            if faults[i] in "t-":
                late = faults[i] == "t"
                if role:
                    steps.append((late, "K", 1, role[0], (f"{role}:{text}",)))
                steps += [(2 + late, "R", 1, name[0], (f"{name}:{text}",)) for name in ("user", "assistant")]
        if not audit.endswith("II"):
            steps += [(2, "I", 0, name[0], (f"{name}:",)) for name in ("user", "assistant")]
        for more, letter, ahead, initial, line in steps:
            if may_follow(initials + initial):
                heapq.heappush(heap, (cost + more, audit + letter, i + ahead, initials + initial, lines + line))


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, cost, audit, lines = cheapest(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), wrong, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations():
    rng = random.Random(12)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", ""]
    texts = ["a.", "b!", "c", "", " \n", "d?\t", "e .x", "f.", "g.", "ü", "i.", "j.", "k\u00a0"]
    out = {k: [(rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 7))] for k in range(80)}
    out[None] = [(1, "user", "hi."), (2, "user", "x")]
    out[100] = [(t, "tool", f"{t}.") for t in range(9)]  # every vector is carried on, none converge
    out[101] = [(t, "user", "same.") for t in range(9)]
    out[102] = [(3, "user", "same.")] * 7
    out[103] = [(t, r, f"{t}.") for t, r in enumerate(["user", "assistant"] * 5)]
    return out


@pytest.fixture(scope="module")
def rows(spark):
    every = [(k, *r, "x", "y") for k, own in conversations().items() for r in own]
    random.Random(1).shuffle(every)
    return dialogue.with_copies(spark.createDataFrame(every, MESSAGES).repartition(3))


@pytest.fixture(scope="module")
def wanted():
    return {k: expected(own) for k, own in conversations().items()}


@pytest.mark.parametrize("chunk_rows, passes", [(dialogue.CHUNK_ROWS, 6), (1, 20), (2, 0), (3, 1)])
def test_repair(rows, wanted, chunk_rows, passes):
    found = {r[0]: tuple(r)[1:] for r in dialogue.repair(rows, chunk_rows, passes=passes).collect()}
    assert found == wanted


def test_chunks_of_few_bytes(rows, wanted):
    found = {r[0]: tuple(r)[1:] for r in dialogue.repair(rows, chunk_bytes=4).collect()}
    assert found == wanted


def test_fix_up_stops_where_vectors_are_parallel():
    trellis, codes = dialogue.Trellis(), bytes(dialogue.code_of(r, False) for r in ["user", "assistant"] * 500)
    assert trellis.fix_up(codes, dialogue._END, (0, 9, 2, 0)) == (None, 1)
    found, done = trellis.fix_up(codes, dialogue._END, (5, 2, 0, 2))
    assert done <= 4 and (found is None or done == len(codes))
    stubborn = bytes([dialogue.code_of("tool", False)]) * 50
    assert trellis.fix_up(stubborn, dialogue._END, (2, 2, 0, 2))[1] == 50


def damage(conv, turn, role, text):
    word = lambda x: " " if x is None else str(x)
    kind, role, text = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20, word(role), word(text)
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


@pytest.mark.parametrize("chunk_rows", [dialogue.CHUNK_ROWS, 2])
def test_damaged_conversations(spark, chunk_rows):
    rng = random.Random(4)
    messages = [(k, t, rng.choice(["user", "assistant", None]), rng.choice(["Yes. No", "a!", None, f"{t}.", "long " * 3]), None, None)
                for k in [None, *range(60)] for t in [None, *range(rng.randint(0, 5))]]
    lost = [k for k in range(61, 400) if zlib.crc32(f"{k}:1".encode()) % 20 == 0][:3]
    messages += [(k, 1, "user", "a.", None, None) for k in lost] + messages[:2]
    found = {r[0]: tuple(r)[1:] for r in dialogue.repair(dialogue.damaged(spark.createDataFrame(messages, MESSAGES)), chunk_rows).collect()}
    after = {}
    for k, *m, _, _ in messages:
        after.setdefault(k, []).extend(damage(k, *m))
    empty = hashlib.sha256(b"").hexdigest()
    assert found == {k: expected(own) if own else (0, 0, 0, 0, 0, 0, "", empty) for k, own in after.items()}
    assert all(found[k] == (0, 0, 0, 0, 0, 0, "", empty) for k in lost)


def test_no_rows(spark):
    assert dialogue.repair(dialogue.damaged(spark.createDataFrame([], MESSAGES))).collect() == []


def test_a_very_long_conversation(spark):
    """Thousands of rows and a long text in one conversation give the same in one task and in chunks."""
    rng = random.Random(7)
    own = [(1, t, rng.choice(["user", "assistant", "tool"]), rng.choice([f"{t}.", f"{t}", "same."]), None, None) for t in range(3000)]
    own[5] = (1, 5, "user", "x" * 1_000_000 + ".", None, None)
    df = dialogue.with_copies(spark.createDataFrame(own, MESSAGES))
    whole = dialogue.repair(df).collect()
    assert dialogue.repair(df, 100).collect() == whole
