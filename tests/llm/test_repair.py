"""Conversation repair against a brute-force search over whole audits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
#: The form as an automaton over role initials.
FORM = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}
WANTED = {"0": "user", "1": "user", "2": "assistant", "3": "user"}


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range((1, 0)[kind == 0] + (kind == 3)):
            yield conv, turn, "user" if kind == 4 else role, text


def search(messages, faults):
    """(cost, audit) of the cheapest edits, by the best whole rest from each message and state."""
    n = len(messages)
    best = [dict.fromkeys("0123", (1 << 30, "")) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for _ in range(4):
            for q in "0123":
                options = [(0, "")] if i == n and q in "03" else []
                for initial in "ua":
                    if (q, initial) in FORM:
                        cost, rest = best[i][FORM[q, initial]]
                        options.append((cost + 5, "I" + rest))
                if i < n:
                    cost, rest = best[i + 1][q]
                    options.append((cost + 2, "D" + rest))
                    for letter, price, initials in (("K", 0, messages[i][1][:1]), ("R", 1, "ua")):
                        for initial in initials if faults[i] in ("", "truncated") else "":
                            if (q, initial) in FORM:
                                cost, rest = best[i + 1][FORM[q, initial]]
                                options.append((cost + price + (5 if faults[i] else 0), letter + rest))
                if options:
                    best[i][q] = min(options)
    return best[0]["0"]


def one(messages):
    messages = sorted(messages, key=lambda m: (m[0] is not None, m[0] or 0, m[1], hashlib.sha256(m[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in messages:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else ""
        faults.append(fault or ("truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(messages, messages[1:]))
    turns = {m[0] for m in messages if m[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = search(messages, faults)
    left, state, lines = list(messages), "0", []
    for letter in audit:
        _, role, text = left.pop(0) if letter != "I" else (None, None, "")
        if letter != "D":
            role = role if letter == "K" else WANTED[state]
            state = FORM[state, role[0]]
            lines.append(f"{role}:{text}")
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def truth(rows):
    conversations = {r[0]: [] for r in rows}
    for conv, *message in damaged(rows):
        conversations[conv].append(message)
    return {c: one(m) for c, m in conversations.items()}


def check(df):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in repair.repair_damaged(df).collect()]
    want = truth(rows)
    assert len(got) == len(want) and {r[0]: r[1:] for r in got} == want


@pytest.fixture(scope="module")
def awkward_rows():
    dice = random.Random(11)
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", None, "u", "User"]
    texts = ["a.", "b?", "c", "  ", "", None, "x.", "é \U0001F600!", "y" * 3000 + ".", "t\x0b\n"]
    rows = []
    for conv in range(700):
        for k in range(dice.randint(0, 14)):
            turn = dice.choice([None, k, k, k, k, dice.randint(0, 9)])
            text = dice.choice([*texts, f"m{k}.", f"t{k}"])
            rows.append((conv if conv % 97 else None, turn, dice.choice(roles), text))
    return rows + rows[:50]


def test_given_conversations(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))


def test_awkward_conversations(spark, awkward_rows):
    df = spark.createDataFrame(awkward_rows, SCHEMA)
    for name in ("conv", "known", "digest", "audit", "kind", "copy", "fault"):
        df = df.withColumn(name, F.lit("clash"))
    check(df)
    assert repair.repair_damaged(df.limit(0)).count() == 0


def test_small_batches_carry_the_state(spark, awkward_rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        check(spark.createDataFrame(awkward_rows[:1500], SCHEMA))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_giant_conversation_spools(monkeypatch):
    """Backpointers of a long conversation go through the file and come back in order."""
    monkeypatch.setattr(repair, "_SPOOL_BYTES", 1000)
    monkeypatch.setattr(repair, "_BLOCK", 64)
    dice = random.Random(2)
    messages = [(k, dice.choice(["user", "assistant", "system", "tool"]), f"m{k}" + dice.choice(["", "."])) for k in range(3000)]
    faults = ["" if m[2].endswith(".") else "truncated" for m in messages]
    program = repair._Program()
    conversation = repair._Conversation("=1", program)
    for (turn, role, _), fault in zip(messages, faults):
        conversation.add(True, turn, role[:1], repair.CUT if fault else repair.FINE)
    assert conversation._trail._file._rolled
    assert conversation.result()[-2:] == search(messages, faults)
    assert len(program.states) < 2000


def test_messages_have_the_form(spark):
    df = repair.damage(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    _, messages = repair.repair_conversations(df)
    by = defaultdict(list)
    for r in messages.collect():
        by[r.conv].append((r.number, r.role[0]))
    assert by and all(re.fullmatch("s?(ua)+", "".join(i for _, i in sorted(m))) for m in by.values())
