"""Conversations repaired to the form (system)? (user assistant)+ at the least cost.

Messages of a conversation are taken by turn (NULL first), those of one turn by role and digest of
the text. Each message is kept (cost 0), given the role user or assistant (1) or deleted (2), and an
empty user or assistant message may be put in anywhere (5). Blank messages and repeated ones must
go; a truncated one that stays costs 5 more. The audit is the initials of the edits in order (Keep,
Rerole, Delete, Insert); of the cheapest edits the ASCII-least audit is taken.

A first stream reads narrow rows (no texts), secondary-sorted: repartitioned by conversation, sorted
by turn. It carries the state of a dynamic program over the four places in the form across Arrow
batches: per place the cheapest cost and the rank of its audit among the others. That is all it
needs, as an audit determines its place, and no audit of the same messages is a prefix of another.
States are numbered as they turn up and transitions are looked up. Backpointers are one number for
each message, spooled to an unnamed file beyond 4 MB, and read backwards when the conversation ends.
A second stream follows the audits through the texts.

A conversation passes one task as a stream, however long it is, in memory that does not grow with it
but for its audit, one byte for each message. Repeats are found by a window that spills.

Defined results: NULL roles and texts count as one space. NULL conversation ids are one
conversation. Repeated rows are repeats. Very long texts are read once. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.session import materialise

_BLANKS = " \t\n\x0b\x0c\r"
_SPOOL_BYTES = 4_000_000
_BLOCK = 1 << 16

#: Places in the form: at the start, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Role that the form wants next, and the place it leads to.
WANTED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: Role initials that may be kept at a place.
ALLOWED = {
    START: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}
#: Inserts that complete the form from a place.
ENDING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FINE, BLANK, DUPLICATE, CUT = range(4)


def _key(conv_id: Column) -> Column:
    """Conversation id as text, never NULL."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _rows(conversations: DataFrame) -> DataFrame:
    space = F.lit(" ")
    rows = conversations.select(
        _key(F.col("conv_id")).alias("conv"),
        F.col("turn").isNotNull().alias("known"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    )
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


ORDER = ["conv", "known", "turn", "role", "digest"]


def _sketches(rows: DataFrame) -> DataFrame:
    """Narrow rows in order, with their first fault."""
    ends = F.right(F.rtrim("text", F.lit(_BLANKS)), F.lit(1))
    narrow = rows.select(
        *ORDER,
        (F.btrim("text", F.lit(_BLANKS)) == "").alias("blank"),
        (~ends.isin(".", "!", "?")).alias("cut"),
    ).repartition("conv")
    # The window needs no exchange of its own; it spills, however often a message is repeated.
    same = Window.partitionBy("conv", "role", "digest").orderBy("known", "turn")
    fault = (
        F.when(F.col("blank"), BLANK)
        .when(F.row_number().over(same) > 1, DUPLICATE)
        .when(F.col("cut"), CUT)
        .otherwise(FINE)
    )
    return narrow.select(*ORDER, fault.alias("fault")).sortWithinPartitions(*ORDER)


class _Program:
    """The dynamic program as a machine whose states and transitions are found as needed.

    A state has for each place the cost over the cheapest place and the rank of the audit, or None.
    """

    def __init__(self):
        self._numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.start = self._number(((0, 0), None, None, None))
        self._moves: dict[tuple[int, int, str], tuple[int, int, int]] = {}
        self.pointers: list[dict[int, tuple[int, str]]] = []

    def _number(self, state: tuple) -> int:
        if state not in self._numbers:
            self._numbers[state] = len(self.states)
            self.states.append(state)
        return self._numbers[state]

    def move(self, state: int, fault: int, initial: str) -> tuple[int, int, int]:
        """Next state, cost to add, and the number of the backpointers."""
        initial = initial if initial in ("s", "u", "a") else ""
        found = self._moves.get((state, fault, initial))
        if found is None:
            found = self._moves[state, fault, initial] = self._find(state, fault, initial)
        return found

    def _find(self, state: int, fault: int, initial: str) -> tuple[int, int, int]:
        best: dict[int, tuple[int, int, str, int]] = {}
        for place, entry in enumerate(self.states[state]):
            if entry is None:
                continue
            cost, rank = entry
            at, before = place, ""
            # After two inserts the form repeats.
            for _ in range(3):
                edits = [("D", DELETE, at)]
                if fault in (FINE, CUT):
                    stays = TRUNCATED if fault == CUT else 0
                    edits.append(("R", REROLE + stays, WANTED[at][1]))
                    if initial in ALLOWED[at]:
                        edits.append(("K", stays, ALLOWED[at][initial]))
                for letter, price, to in edits:
                    option = (cost + INSERT * len(before) + price, rank, before + letter, place)
                    best[to] = min(best.get(to, option), option)
                at, before = WANTED[at][1], before + "I"
        least = min(option[0] for option in best.values())
        order = sorted(best, key=lambda to: best[to][1:3])
        after = tuple((best[to][0] - least, order.index(to)) if to in best else None for to in range(4))
        self.pointers.append({to: (option[3], option[2]) for to, option in best.items()})
        return self._number(after), least, len(self.pointers) - 1


class _Trail:
    """Backpointers of one conversation, one number for each message."""

    def __init__(self):
        self._file = tempfile.SpooledTemporaryFile(_SPOOL_BYTES)
        self._new = array("I")

    def append(self, number: int) -> None:
        self._new.append(number)
        if len(self._new) == _BLOCK:
            self._flush()

    def _flush(self) -> None:
        self._file.write(self._new.tobytes())
        self._new = array("I")

    def backwards(self) -> Iterator[int]:
        self._flush()
        width = self._new.itemsize
        end = self._file.tell()
        while end:
            first = max(0, end - _BLOCK * width)
            self._file.seek(first)
            block = array("I")
            block.frombytes(self._file.read(end - first))
            yield from reversed(block)
            end = first
        self._file.close()


class _Conversation:
    def __init__(self, conv: str, program: _Program):
        self._conv, self._program = conv, program
        self._state, self._cost, self._trail = program.start, 0, _Trail()
        self._faults = [0, 0, 0, 0]
        self._illegal, self._last = 0, None
        self._first_turn = self._turn = None
        self._turns = 0

    def add(self, known: bool, turn: int, initial: str, fault: int) -> None:
        self._faults[fault] += 1
        if self._last is not None and self._last + initial not in ("su", "ua", "au"):
            self._illegal += 1
        self._last = initial
        if known and turn != self._turn:
            self._first_turn = turn if self._first_turn is None else self._first_turn
            self._turn = turn
            self._turns += 1
        self._state, more, pointer = self._program.move(self._state, fault, initial)
        self._cost += more
        self._trail.append(pointer)

    def result(self) -> tuple:
        ends = []
        for place, entry in enumerate(self._program.states[self._state]):
            if entry is not None:
                ends.append((entry[0] + INSERT * len(ENDING[place]), entry[1], ENDING[place], place))
        more, _, ending, place = min(ends)
        pieces = [ending]
        for pointer in self._trail.backwards():
            place, letters = self._program.pointers[pointer][place]
            pieces.append(letters)
        gaps = self._turn - self._first_turn + 1 - self._turns if self._turns else 0
        faults = (self._faults[BLANK], self._faults[DUPLICATE], self._faults[CUT])
        return (self._conv, gaps, *faults, self._illegal, self._cost + more, "".join(reversed(pieces)))


PLAN = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [column.split()[0] for column in PLAN.split(", ")]
    program, open_one, conv = _Program(), None, None
    for batch in batches:
        done = []
        for c, known, turn, role, fault in zip(*(batch[n] for n in ("conv", "known", "turn", "role", "fault"))):
            if c != conv:
                if open_one is not None:
                    done.append(open_one.result())
                open_one, conv = _Conversation(c, program), c
            open_one.add(known, turn, role[:1], fault)
        if done:
            yield pd.DataFrame(done, columns=names)
    if open_one is not None:
        yield pd.DataFrame([open_one.result()], columns=names)


def plan_repairs(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, the cost of the repair, and the audit.

    ``conv`` names the conversation, see ``conversation_id``.
    """
    sketches = _sketches(_rows(conversations)).select("conv", "known", "turn", "role", "fault")
    return sketches.mapInPandas(_plan, PLAN)


def conversation_id(conv: Column, kind: str) -> Column:
    """The id that ``conv`` stands for, as type ``kind``."""
    return F.when(conv != "", F.substring(conv, 2, 1 << 30)).cast(kind)


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, audit, at, place, number = None, "", 0, START, 0
    columns = ["conv", "number", "edit", "turn", "role", "text"]
    for batch in batches:
        out = []

        def put(edit, turn, role, text):
            nonlocal number
            out.append((conv, number, edit, turn, role, text))
            number += 1

        def inserts():
            nonlocal at, place
            while at < len(audit) and audit[at] == "I":
                role, place = WANTED[place]
                put("I", None, role, "")
                at += 1

        for c, plan, known, turn, role, text in zip(
            *(batch[n] for n in ("conv", "audit", "known", "turn", "role", "text"))
        ):
            if plan is not None:
                inserts()
                conv, audit, at, place, number = c, plan, 0, START, 0
                continue
            inserts()
            edit = audit[at]
            at += 1
            if edit == "K":
                place = ALLOWED[place][role[:1]]
            elif edit == "R":
                role, place = WANTED[place]
            if edit != "D":
                put(edit, str(turn) if known else None, role, text)
        yield pd.DataFrame(out, columns=columns)
    # ``conv`` is the last conversation, whose closing inserts are still due.
    out = []
    while at < len(audit):
        role, place = WANTED[place]
        out.append((conv, number, "I", None, role, ""))
        number, at = number + 1, at + 1
    if out:
        yield pd.DataFrame(out, columns=columns)


def repaired_messages(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """Messages of the repaired conversations: (conv, number, edit, turn, role, text).

    Each partition holds whole conversations, in order.
    """
    plain = lambda name, kind: F.lit(None).cast(kind).alias(name)
    rows = _rows(conversations).select(*ORDER, "text", plain("audit", "string"))
    rules = plans.select(
        "conv", plain("known", "boolean"), plain("turn", "long"), plain("role", "string"),
        plain("digest", "binary"), plain("text", "string"), "audit",
    )
    # The audit has no ``known`` and so comes first.
    both = rows.union(rules).repartition("conv").sortWithinPartitions(*ORDER)
    filled = both.select("conv", "audit", F.coalesce("known", F.lit(False)).alias("known"),
                         F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text")
    followed = filled.mapInPandas(_follow, "conv string, number long, edit string, turn string, role string, text string")
    return followed.withColumn("turn", F.col("turn").cast("long"))


def _hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, digest = None, None
    for batch in batches:
        done = []
        for c, role, text in zip(batch["conv"], batch["role"], batch["text"]):
            if c != conv:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if done:
            yield pd.DataFrame(done, columns=["conv", "sha256"])
    if digest is not None:
        yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv", "sha256"])


def conversation_digests(messages: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` lines for each conversation of ``repaired_messages``."""
    return messages.select("conv", "role", "text").mapInPandas(_hash, "conv string, sha256 string")


def repair_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans (written once) and the repaired messages."""
    plans = materialise(plan_repairs(conversations), "repair-plans")
    return plans, repaired_messages(conversations, plans)


# ---- damage for trials ------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Faults by CRC-32 of ``conv_id:turn``, a fifth of the rows: dropped, emptied, without end marks,
    repeated, or said by the user. NULL counts as one space.
    """
    space = F.lit(" ")
    name = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    )
    kind = F.crc32(name) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage and repair, one row for each conversation id with the digest of what it has become."""
    plans, messages = repair_conversations(damage(conversations))
    kind = conversations.schema["conv_id"].dataType.simpleString()
    ids = conversations.select(_key(F.col("conv_id")).alias("conv")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        ids.join(plans, "conv", "left")
        .join(conversation_digests(messages), "conv", "left")
        .select(
            conversation_id(F.col("conv"), kind).alias("conv_id"),
            *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
        )
    )
