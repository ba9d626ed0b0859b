"""Repair of conversations' structure by the cheapest edits.

Each conversation's turns are kept, given another role or deleted, and empty turns are put
in, so that an optional system turn and then pairs of user and assistant remain. The
turns that stay form a subsequence: a turn that stays in a role pays for what stands
between it and the next one that stays, the deletions (a difference of prefix sums) and
the insertions that the two roles ask for. Run from the last turn to the first, a running
minimum for each role over what follows gives the best next turn in constant time. Among
equal costs the next turn is the one furthest off, and then the one with the least edits'
initials, which makes the whole audit the ASCII-least: within a gap deletions come first,
and a deletion sorts before any other edit.

Two passes keep texts out of memory. The first sorts rows without texts by conversation
and holds a few bytes for each turn of one conversation, as its audit is that long anyhow.
The second sorts the texts behind their conversation's audit and reads them as a stream.

Defined cases: null roles and texts are one space; a null conv_id is a conversation of its
own; null turns come first; turns of one number are ordered by role and text, and equal
ones stand together; roles whose first letter is none of s, u, a (an empty role has none)
can't be kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Prices of edits, and of a turn that stays although it breaks off.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
S, U, A, START, END = 0, 1, 2, 3, 4
ROLES = ("system", "user", "assistant")
INITIALS = {"s": S, "u": U, "a": A}
#: Turns put in between a role and the next: their number, where the two may follow each other at all.
BETWEEN = {
    (START, S): 0, (START, U): 0, (START, A): 1, (START, END): 0,
    (S, U): 0, (S, A): 1, (S, END): 2,
    (U, A): 0, (U, U): 1, (U, END): 1,
    (A, U): 0, (A, A): 1, (A, END): 0,
}
_NEXT = {r: [q for q in (U, A, S) if (r, q) in BETWEEN] for r in (START, S, U, A)}
FAULTS = ("blank", "duplicate", "truncated")
_TEXT = r"[^\x20\x09-\x0D]"


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, their order's key, and fault (blank, duplicate, truncated or null) of each row."""
    base = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    base = base.withColumn("digest", F.unhex(F.sha2("text", 256)))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(~F.col("text").rlike(_TEXT), "blank").when(seen > 1, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    return base.withColumn("fault", fault)


class Stays:
    """Which turns of one conversation stay, in which role; turns are given by first letters and faults."""

    def __init__(self, initials: list[int | None], must: list[bool], broken: list[bool]):
        n = self.n = len(initials)
        self.initials = initials
        #  For each turn and role, the next turn that stays (n for none) and its role, from the last turn to the first.
        self.after = [array("q", bytes(8 * n)) for _ in ROLES]
        self.role_after = [bytearray(n) for _ in ROLES]
        least, where = [float("inf")] * 3, [n] * 3  # of cost from a turn on and the deletions before it, for each role
        for i in range(n - 1, -1, -1):
            if must[i]:
                continue
            found = []
            for r in (S, U, A):
                own = 0 if initials[i] == r else REROLE if r != S else None
                if own is not None:
                    cost, j, q = self._next(r, least, where, DELETE * (i + 1))
                    self.after[r][i], self.role_after[r][i] = j, q
                    found.append((r, own + TRUNCATED * broken[i] + cost + DELETE * i))
            for r, cost in found:
                if cost < least[r]:  # of equal ones the later turn stays
                    least[r], where[r] = cost, i
        self.cost, self.first, self.first_role = self._next(START, least, where, 0)

    def _next(self, r: int, least: list[float], where: list[int], before: int) -> tuple[int, int, int]:
        """Cost, turn and role of what best follows role ``r``, all turns before it deleted from prefix sum ``before`` on."""
        cost, j, q = DELETE * self.n - before + INSERT * BETWEEN[r, END], self.n, END
        for t in _NEXT[r]:
            new = least[t] - before + INSERT * BETWEEN[r, t]
            if new < cost or new == cost and (where[t] > j or where[t] == j and self._letters(r, j, t) < self._letters(r, j, q)):
                cost, j, q = new, where[t], t
        return cost, j, q

    def _letters(self, r: int, j: int, q: int) -> str:
        return "I" * BETWEEN[r, q] + ("" if q == END else "K" if self.initials[j] == q else "R")

    def audit(self) -> str:
        """Initials of all edits in order."""
        out, i, r, j, q = [], -1, START, self.first, self.first_role
        while True:
            out.append("D" * (j - i - 1) + self._letters(r, j, q))
            if q == END:
                return "".join(out)
            i, r = j, q
            j, q = self.after[r][i], self.role_after[r][i]


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of :func:`faults`' rows."""

    def one(conv: str | None, turns: list[int], initials: list[str], kinds: list[str | None]) -> tuple:
        codes = [INITIALS.get(x) for x in initials]
        fits = sum(x + y in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
        best = Stays(codes, [k in FAULTS[:2] for k in kinds], [k == FAULTS[2] for k in kinds])
        gaps = turns[-1] - turns[0] + 1 - (1 + sum(x != y for x, y in zip(turns, turns[1:], strict=False))) if turns else 0
        return (conv, gaps, *(kinds.count(f) for f in FAULTS), max(0, len(initials) - 1 - fits), best.cost, best.audit())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, turns, initials, kinds, out = None, [], [], [], []
        for f in frames:
            for conv, turn, initial, kind in zip(*(f[c].tolist() for c in ("conv", "turn", "initial", "fault")), strict=True):
                if conv != now and initials:
                    out.append(one(now, turns, initials, kinds))
                    turns, initials, kinds = [], [], []
                now = conv
                if turn is not None:
                    turns.append(int(turn))
                initials.append(initial), kinds.append(kind)
            yield pd.DataFrame(out, columns=names)
            out = []
        if initials:
            yield pd.DataFrame([one(now, turns, initials, kinds)], columns=names)

    names = ["conv", "gaps", *FAULTS, "illegal", "cost", "audit"]
    #  As strings numbers pass through pandas unchanged, null or not.
    slim = rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), F.substring("role", 1, 1).alias("initial"), "fault", *_order())
    slim = slim.repartition("conv").sortWithinPartitions("conv", "by_turn", "by_role", "by_text", "by_copy").select("conv", "turn", "initial", "fault")
    found = slim.mapInPandas(run, f"conv string, {', '.join(f'{c} long' for c in names[1:-1])}, audit string")
    return found.select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *names[1:])


def _order() -> list[Column]:
    """Keys of the order of a conversation's turns; nulls come first in an ascending order."""
    return [F.col("turn").alias("by_turn"), F.col("role").alias("by_role"), F.col("digest").alias("by_text"), (F.col("fault") == "duplicate").alias("by_copy")]


def _edited(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv, audit, role, text: each conversation's audit and behind it its turns in order."""
    turns = rows.select(F.col("conv_id").cast("string").alias("conv"), F.lit(None).cast("string").alias("audit"), "role", "text", F.lit(1).alias("kind"), *_order())
    heads = found.select(F.col("conv_id").cast("string").alias("conv"), "audit", F.lit(0).alias("kind"))
    both = turns.unionByName(heads, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "kind", "by_turn", "by_role", "by_text", "by_copy").select("conv", "audit", "role", "text")


def _stream(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple[str | None, bool, str, str]]]:
    """(conv, whether it begins, role, text) of the turns that remain, one list a batch; the first of a conversation is empty."""
    audit, at, last = "", 0, START

    def inserted(out: list, conv: str | None) -> None:
        nonlocal at, last
        while audit[at : at + 1] == "I":
            last = A if last == U else U
            out.append((conv, False, ROLES[last], ""))
            at += 1

    for f in frames:
        out: list[tuple[str | None, bool, str, str]] = []
        for conv, head, role, text in zip(*(f[c].tolist() for c in ("conv", "audit", "role", "text")), strict=True):
            if head is not None:
                audit, at, last = head, 0, START
                out.append((conv, True, "", ""))
            else:
                edit = audit[at]
                at += 1
                if edit == "K":
                    last = INITIALS[role[0]]
                    out.append((conv, False, role, text))
                elif edit == "R":
                    last = A if last == U else U
                    out.append((conv, False, ROLES[last], text))
            inserted(out, conv)
        yield out


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of the turns of the repaired conversations."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = 0
        for turns in _stream(frames):
            out = []
            for conv, begins, role, text in turns:
                if begins:
                    place = 0
                else:
                    out.append((conv, place, role, text))
                    place += 1
            yield pd.DataFrame(out, columns=["conv", "place", "role", "text"])

    marked = faults(rows)
    edited = _edited(marked, written(audits(marked), "audits"))
    kind = rows.schema["conv_id"].dataType
    return edited.mapInPandas(run, "conv string, place long, role string, text string").select(F.col("conv").cast(kind).alias("conv_id"), "place", "role", "text")


def repairs(rows: DataFrame) -> DataFrame:
    """What :func:`audits` finds, and repaired_sha256 of the repaired turns as ``role:text``, joined by line feeds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest, first, any_ = None, hashlib.sha256(), True, False
        for turns in _stream(frames):
            out = []
            for conv, begins, role, text in turns:
                if begins:
                    if any_:
                        out.append((now, digest.hexdigest()))
                    now, digest, first, any_ = conv, hashlib.sha256(), True, True
                else:
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
        if any_:
            yield pd.DataFrame([(now, digest.hexdigest())], columns=["conv", "repaired_sha256"])

    marked = faults(rows)
    found = written(audits(marked), "audits")
    digests = _edited(marked, found).mapInPandas(run, "conv string, repaired_sha256 string")
    same = found.conv_id.cast("string").eqNullSafe(F.col("conv"))
    return found.join(digests, same).drop("conv")
