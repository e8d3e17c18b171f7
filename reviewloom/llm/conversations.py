"""Repair of damaged conversations by cheapest edits.

A repaired conversation has the role initials ``(s?(ua)+)?``. Every row is kept, given another
role or deleted, and empty turns may be inserted; of the cheapest edits those with the
ASCII-least audit (the initials of the edits, in order) are taken.

Cost and audit are one whole number: its high digits are the cost, its low digits are the letters
of the audit from the left, three bits each at a fixed place, with zeros after the end. Letters
have their ASCII order and the end is less than all, so the smallest number is the answer, and
an ordinary shortest path over (rows done, state of the pattern) decides everything. Two paths to
one node that cost the same never have audits of which one begins the other, since what is left
would be insertions, and these cost: the smaller number stays the smaller whatever follows.

Rows are dealt by conversation and sorted by Spark; a task streams over them and holds one audit,
not one conversation. Letters that all open paths share are final and leave the numbers, so that
these stay short in conversations of any length. A first pass takes narrow rows and gives the
audits. A second one puts each audit before the rows of its conversation and streams the texts
into the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

#: The space and the code points 9 to 13; a text without any other character is blank.
WHITE = " \t\n\x0b\x0c\r"
#: Edits in ASCII order; their numbers are the digits of an audit, 0 is its end.
LETTERS = "?DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
#: States: nothing yet, after s, after u, after a. The first and the last may be the end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: state -> {initial: next state}
STEPS = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
ROLE_OF = {"u": "user", "a": "assistant"}
#: Letters that a number has room for before shared ones are taken out.
ROOM = 64
_BITS = 3


class Repair:
    """Cheapest edits of one conversation, row by row.

    ``add`` takes the initial of a row's role and its faults. ``finish`` gives the cost and the
    audit. Numbers have room for ``ROOM`` letters, or for twice the letters that differ.
    """

    def __init__(self) -> None:
        self.audit: list[str] = []  # letters that all open paths share
        self.base = 0  # cost that all open paths share
        self.room = ROOM
        self.nodes: list[tuple[int, int] | None] = [(0, 0), None, None, None]

    def _edge(self, node: tuple[int, int], letter: int, cost: int) -> tuple[int, int]:
        """A node is (number, letters in it); the letter goes to the next free place."""
        number, used = node
        place = _BITS * (self.room - 1 - used)
        return number + (cost << (_BITS * self.room)) + (letter << place), used + 1

    def _insertions(self) -> None:
        """Insertions at this place, until no path gets smaller by one; all of them cost."""
        changed = True
        while changed:
            changed = False
            for state, node in enumerate(self.nodes):
                for initial in ROLE_OF if node else ():
                    to = STEPS[state].get(initial)
                    if to is None:
                        continue
                    found = self._edge(node, INSERT, COST[INSERT])
                    if self.nodes[to] is None or found < self.nodes[to]:
                        self.nodes[to] = found
                        changed = True

    def _make_room(self, letters: int) -> None:
        """Keep ``letters`` places free, by taking out shared letters and shared cost."""
        longest = max(node[1] for node in self.nodes if node)
        if longest + letters <= self.room:
            return
        self._drop_hopeless()
        open_nodes = [node for node in self.nodes if node]
        low = _BITS * self.room
        mask = (1 << low) - 1
        tails = [node[0] & mask for node in open_nodes]
        differ = 0
        for tail in tails:
            differ |= tail ^ tails[0]
        shared = min(self.room - -(-differ.bit_length() // _BITS), *[node[1] for node in open_nodes])
        self._take(tails[0], shared)
        cost = min(node[0] >> low for node in open_nodes)
        self.base += cost
        longest = max(node[1] for node in open_nodes) - shared
        room = max(ROOM, 2 * (longest + letters))
        moved: list[tuple[int, int] | None] = []
        for node in self.nodes:
            if node is None:
                moved.append(None)
                continue
            number, used = node
            tail = (number & mask) & ((1 << (_BITS * (self.room - shared))) - 1)
            tail = tail << (_BITS * (room - self.room + shared)) if room >= self.room - shared else (
                tail >> (_BITS * (self.room - shared - room))
            )
            moved.append(((((number >> low) - cost) << (_BITS * room)) + tail, used - shared))
        self.nodes, self.room = moved, room

    def _drop_hopeless(self) -> None:
        """Close paths that another one beats whatever follows.

        From after an assistant's turn everything can follow that can at the start or after s,
        but for a kept system row, which may be deleted instead at 2 more.
        """
        best = self.nodes[AFTER_A]
        if best is None:
            return
        cost = best[0] >> (_BITS * self.room)
        for state, more in ((START, COST[DELETE]), (AFTER_S, 0)):
            node = self.nodes[state]
            if node and (node[0] >> (_BITS * self.room)) > cost + more:
                self.nodes[state] = None

    def _take(self, tail: int, letters: int) -> None:
        for place in range(letters):
            digit = tail >> (_BITS * (self.room - 1 - place)) & 7
            self.audit.append(LETTERS[digit])

    def add(self, initial: str, unusable: bool, truncated: bool) -> None:
        self._make_room(4)
        self._insertions()
        after: list[tuple[int, int] | None] = [None] * 4

        def offer(to: int, found: tuple[int, int]) -> None:
            if after[to] is None or found < after[to]:
                after[to] = found

        kept = TRUNCATED_COST if truncated else 0
        for state, node in enumerate(self.nodes):
            if node is None:
                continue
            offer(state, self._edge(node, DELETE, COST[DELETE]))
            if unusable:
                continue
            steps = STEPS[state]
            if initial in steps:
                offer(steps[initial], self._edge(node, KEEP, COST[KEEP] + kept))
            for role in ROLE_OF:
                if role in steps:
                    offer(steps[role], self._edge(node, REROLE, COST[REROLE] + kept))
        self.nodes = after

    def finish(self) -> tuple[int, str]:
        self._make_room(4)
        self._insertions()
        number, used = min(node for node in (self.nodes[START], self.nodes[AFTER_A]) if node)
        low = _BITS * self.room
        self._take(number & ((1 << low) - 1), used)
        return self.base + (number >> low), "".join(self.audit)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy, gone`` after damage, decided by crc32(conv_id:turn) % 20.

    0 drops the row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats it (``copy`` is 1
    for the second one), 4 makes the user say it. Nulls are one space, in roles and texts and
    in the text that is hashed; null conv_id and turn stay null as keys. Dropped rows stay as
    rows with ``gone`` set, so that their conversation is known.
    """
    space = F.lit(" ")
    plain = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    )
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), space),
    )
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", ""))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return plain.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(times).alias("copy"),
    )


def _order() -> list[Column]:
    """Rows of a conversation: by turn, nulls first; equal turns by role and digest, copies last."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("copy")]


def faults(rows: DataFrame) -> DataFrame:
    """First fault of each damaged row: ``blank``, ``duplicate``, ``truncated`` or ``none``.

    A row is a duplicate if an earlier one of its conversation has its role and text. Text is
    compared by its SHA-256; of equal rows only the narrow form is shuffled.
    """
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    narrow = rows.select(
        "conv_id",
        "turn",
        "role",
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
        "copy",
        "gone",
        last.alias("last"),
    )
    nth = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(*_order()))
    fault = (
        F.when(F.col("last") == "", "blank")
        .when(nth > 1, "duplicate")
        .when(~F.col("last").isin(".", "!", "?"), "truncated")
        .otherwise("none")
    )
    return narrow.withColumn("fault", fault).drop("last")


class _Report:
    """Counts over the rows of one conversation, in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.repair = Repair()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "none": 0}
        self.illegal = self.turns = 0
        self.before: str | None = None
        self.first: int | None = None
        self.last: int | None = None

    def add(self, turn: int | None, role: str, fault: str) -> None:
        initial = role[:1]
        self.counts[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        self.repair.add(initial, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self) -> dict:
        cost, audit = self.repair.finish()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        counts = {k: self.counts[k] for k in ("blank", "duplicate", "truncated")}
        return {"conv_id": self.conv_id, "gaps": gaps, **counts, "illegal": self.illegal,
                "cost": cost, "audit": audit}


_REPORT = pa.schema(
    [("conv_id", pa.int64())]
    + [(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string())]
)
REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One report per conversation; rows come sorted by conversation and order."""
    report: _Report | None = None
    done: list[dict] = []
    for batch in slices(batches, 1024):
        columns = [batch[name].to_pylist() for name in ("conv_id", "turn", "role", "fault", "gone")]
        for conv_id, turn, role, fault, gone in zip(*columns):
            if report is None or report.conv_id != conv_id:
                if report is not None:
                    done.append(report.row())
                report = _Report(conv_id)
            if not gone:
                report.add(turn, role, fault)
        if len(done) >= 256:
            yield pa.RecordBatch.from_pylist(done, schema=_REPORT)
            done = []
    if report is not None:
        done.append(report.row())
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=_REPORT)


def audits(rows: DataFrame) -> DataFrame:
    """Counts, cost and audit of each conversation of ``damaged`` rows."""
    sort = [F.col("conv_id").asc_nulls_first(), *_order()]
    dealt = faults(rows).repartition("conv_id").sortWithinPartitions(*sort)
    return dealt.mapInArrow(_reports, REPORT)


class Edits:
    """Follows an audit row by row; ``feed`` gets the lines of the repaired conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.after = audit, 0, "a"

    def _turn(self, role: str) -> str:
        self.after = role[:1]
        return role

    def _next_role(self) -> str:
        return "assistant" if self.after == "u" else "user"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._turn(self._next_role()), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            yield self._turn(role), text
        elif letter == "R":
            yield self._turn(self._next_role()), text


def _repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the repaired conversations; an audit comes before the rows of its conversation."""
    edits, conv = Edits(""), None
    nth = 0
    rows: list[dict] = []

    def put(found: Iterator[tuple[str, str]]) -> None:
        nonlocal nth
        for role, text in found:
            rows.append({"conv_id": conv, "place": nth, "role": role, "text": text})
            nth += 1

    for batch in slices(batches, 256):
        columns = [batch[name].to_pylist() for name in ("conv_id", "audit", "role", "text")]
        for conv_id, audit, role, text in zip(*columns):
            if audit is not None:
                put(edits.inserted())
                edits, conv, nth = Edits(audit), conv_id, 0
            else:
                put(edits.row(role, text))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)
            rows.clear()
    put(edits.inserted())
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)


_ROWS = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]
)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each repaired conversation, its lines ``role:text`` joined by line feeds."""
    edits, state, conv, some = Edits(""), None, None, False
    done: list[tuple[int | None, str]] = []

    def feed(found: Iterator[tuple[str, str]]) -> None:
        nonlocal some
        for role, text in found:
            state.update((f"\n{role}:{text}" if some else f"{role}:{text}").encode())
            some = True

    def close() -> None:
        if state is not None:
            feed(edits.inserted())
            done.append((conv, state.hexdigest()))

    for batch in slices(batches, 256):
        columns = [batch[name].to_pylist() for name in ("conv_id", "audit", "role", "text")]
        for conv_id, audit, role, text in zip(*columns):
            if audit is not None:
                close()
                edits, state, conv, some = Edits(audit), hashlib.sha256(), conv_id, False
            else:
                feed(edits.row(role, text))
        if len(done) >= 1024:
            yield _hash_batch(done)
            done = []
    close()
    if done:
        yield _hash_batch(done)


def _hash_batch(done: list[tuple[int | None, str]]) -> pa.RecordBatch:
    ids, hashes = zip(*done)
    return pa.record_batch({"conv_id": pa.array(ids, pa.int64()), "repaired_sha256": pa.array(hashes)})


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of each conversation in order, behind a row with its audit."""
    texts = rows.filter("not gone").select(
        "conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role",
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "copy", "text",
    )
    heads = found.selectExpr(
        "conv_id", "audit", "cast(null as bigint) turn", "'' role", "'' digest", "0 copy", "'' text"
    )
    first = F.col("audit").isNull()
    sort = [F.col("conv_id").asc_nulls_first(), first, *_order()]
    dealt = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(*sort)
    return dealt.select("conv_id", "audit", "role", "text")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: the repaired conversations of damaged ``rows``.

    ``found`` are their ``audits``. A conversation without rows left gives none.
    """
    return _with_audits(rows, found).mapInArrow(
        _repaired_rows, "conv_id bigint, place bigint, role string, text string"
    )


def repair_report(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found``, the ``audits`` of damaged ``rows``, with ``repaired_sha256``.

    A null conv_id is a conversation like any other. Rows of equal turn are taken by role and
    SHA-256 of their text. A conversation that lost all its rows has zeros, an empty audit and
    the hash of the empty string. An empty table gives no rows, and other columns are ignored.
    """
    hashes = _with_audits(rows, found).mapInArrow(
        _hashes, "conv_id bigint, repaired_sha256 string"
    )
    hashes = hashes.withColumnRenamed("conv_id", "_of")
    return found.join(hashes, F.col("conv_id").eqNullSafe(F.col("_of"))).drop("_of")
