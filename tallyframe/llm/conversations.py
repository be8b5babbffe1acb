"""Conversations repaired by the cheapest edits, found by Dijkstra's algorithm from both ends."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: What is wrong with a row; only its first fault counts.
FINE, TRUNCATED, BLANK, DUPLICATE = 0, 1, 2, 3
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3

#: What stands at the end of the roles so far: nothing, a system, a user, an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role with the initial, from each state; s?(ua)+ has no others.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ENDS = (START, ASSISTANT)
#: The state and the role that a new or changed role leads to.
FORCED = {START: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
LEGAL = {"su", "ua", "au"}

#: Characters of texts that a conversation may have to be finished where its edits are found.
HELD_CHARACTERS = 16 << 20
_SPACES = re.compile(r"[\x20\x09-\x0d]+\Z")
_BLANK = re.compile(r"[\x20\x09-\x0d]*\Z")


class Lattice:
    """Nodes (rows consumed, state) numbered 4 * rows + state, and the edits between them.

    A row is its role's initial and whether it is kept at a cost or has to go.
    """

    def __init__(self, initials: str, faults: bytes) -> None:
        self.initials, self.faults, self.n = initials, faults, len(faults)

    def forward(self, node: int) -> Iterator[tuple[int, int, str]]:
        """(next node, cost, edit) of each edit at a node."""
        i, q = divmod(node, 4)
        forced = FORCED[q][0]
        yield 4 * i + forced, INSERT_COST, INSERT
        if i == self.n:
            return
        yield node + 4, DELETE_COST, DELETE
        fault = self.faults[i]
        if fault <= TRUNCATED:
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            kept = NEXT.get(self.initials[i], {}).get(q)
            if kept is not None:
                yield 4 * i + 4 + kept, more, KEEP
            yield 4 * i + 4 + forced, REROLE_COST + more, REROLE

    def backward(self, node: int) -> Iterator[tuple[int, int, str]]:
        """(node before, cost, edit) of each edit that leads to a node."""
        i = node // 4
        for q in range(4):
            for before in (4 * i + q, 4 * i + q - 4):
                if before >= 0:
                    for to, cost, edit in self.forward(before):
                        if to == node:
                            yield before, cost, edit


def cheapest_edits(lattice: Lattice) -> tuple[int, str]:
    """The least cost of the edits that make the roles fit s?(ua)+ or nothing, and their audit.

    Two heaps grow, one from the start and one from the ends, the one with the smaller top
    first. The best crossing is an edit from a node settled forwards to one settled in reverse; the
    heaps go on while their tops together do not exceed its cost, so that every crossing
    of that cost is found. Cheapest edits run through the nodes that lead to these crossings, and
    on from them; of all the audits that can be read there the least is taken letter by letter, with all
    nodes that its beginning leads to. Both halves are kept as distances, so that memory follows the rows.
    """
    ends = [4 * lattice.n + q for q in ENDS]
    dist: tuple[dict, dict] = ({}, {})
    reached: tuple[dict, dict] = ({0: 0}, dict.fromkeys(ends, 0))
    heaps = [[(0, 0)], [(0, e) for e in ends]]
    step = (lattice.forward, lattice.backward)
    best = 0 if lattice.n == 0 else None
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        d, node = heapq.heappop(heaps[side])
        if node in dist[side]:
            continue
        dist[side][node] = d
        across = dist[1 - side].get(node)
        if across is not None:
            best = d + across if best is None else min(best, d + across)
        for other, cost, _ in step[side](node):
            if other in dist[1 - side]:
                whole = d + cost + dist[1 - side][other]
                best = whole if best is None else min(best, whole)
            if other not in dist[side] and d + cost < reached[side].get(other, 1 << 60):
                reached[side][other] = d + cost
                heapq.heappush(heaps[side], (d + cost, other))
    # Nodes settled in reverse know what is left; forward ones learn it from the crossings back.
    left = dict(dist[1])
    for node in sorted(dist[0], key=lambda k: (dist[0][k], k // 4), reverse=True):
        rest = best - dist[0][node]
        if left.get(node) is None and any(left.get(to) == rest - cost for to, cost, _ in lattice.forward(node)):
            left[node] = rest
    audit, front, spent = [], {0}, 0
    while spent < best or not any(node in ends for node in front):
        options: dict[str, set[int]] = {}
        price = {}
        for node in front:
            for to, cost, edit in lattice.forward(node):
                if left.get(to) == best - spent - cost:
                    options.setdefault(edit, set()).add(to)
                    price[edit] = cost
        edit = min(options)
        front, spent = options[edit], spent + price[edit]
        audit.append(edit)
    return best, "".join(audit)


def repaired_rows(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) that the edits make of the rows, one at a time."""
    state, rows = START, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(rows)
        if edit == DELETE:
            continue
        if edit == KEEP:
            state = NEXT[role[:1]][state]
        else:
            state, role = FORCED[state]
        yield role, text


def _fault(role: str, text: str, seen: set[bytes]) -> int:
    """The row's first fault; ``seen`` holds a digest of each earlier role and text."""
    if _BLANK.match(text):
        return BLANK
    digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
    if digest in seen:
        return DUPLICATE
    seen.add(digest)
    last = text[-1] if text[-1] not in " \t\n\v\f\r" else _SPACES.sub("", text)[-1]
    return FINE if last in ".!?" else TRUNCATED


class _Conversation:
    """What is known of a conversation while its rows pass."""

    def __init__(self, held: int) -> None:
        self.initials, self.faults, self.seen = [], bytearray(), set()
        self.rows: list | None = []
        self.room, self.illegal, self.turns, self.low, self.high = held, 0, 0, None, None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.high:  # turns ascend
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        initial = role[:1] or " "
        self.illegal += bool(self.initials) and self.initials[-1] + initial not in LEGAL
        self.initials.append(initial)
        self.faults.append(_fault(role, text, self.seen))
        if self.rows is not None:
            self.room -= len(role) + len(text)
            self.rows.append((role, text))
            if self.room < 0:
                self.rows = None

    def result(self) -> dict:
        cost, audit = cheapest_edits(Lattice("".join(self.initials), bytes(self.faults)))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        names = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": TRUNCATED}
        counts = {name: self.faults.count(fault) for name, fault in names.items()}
        whole = None if self.rows is None else _digest(repaired_rows(audit, self.rows))
        return {"gaps": gaps, **counts, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": whole}


def _digest(rows: Iterator[tuple[str, str]]) -> str:
    out = hashlib.sha256()
    for k, (role, text) in enumerate(rows):
        out.update(("\n" if k else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
    return out.hexdigest()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(id, rows) of the conversations in rows sorted by id; a conversation's rows are read as they come."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                yield from batch.slice(low, 1000).to_pylist()

    yield from groupby(rows(), key=lambda r: r["conv_id"])


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_SCHEMA = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
_SCHEMA += [("audit", pa.string()), ("repaired_sha256", pa.string())]


def _judged(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), *_SCHEMA])
    out: list[dict] = []
    letters = 0
    for conv_id, rows in _grouped(batches):
        one = _Conversation(held)
        for r in rows:
            if r["lost"] is not True:
                one.add(r["turn"], r["role"], r["text"])
        out.append({"conv_id": conv_id, **one.result()})
        letters += len(out[-1]["audit"])
        if len(out) == 1000 or letters > 1 << 20:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, letters = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _replayed(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """Repaired rows, or their digest, of conversations whose first row holds the audit."""
    name = "repaired_sha256" if digest else "role"
    kinds = [("conv_id", pa.int64()), (name, pa.string())] + ([] if digest else [("place", pa.int64()), ("text", pa.string())])
    schema = pa.schema(kinds)
    out: list[dict] = []
    for conv_id, rows in _grouped(batches):
        audit = next(rows)["audit"]
        made = repaired_rows(audit, ((r["role"], r["text"]) for r in rows))
        if digest:
            out.append({"conv_id": conv_id, name: _digest(made)})
        for place, (role, text) in enumerate(made if not digest else ()):
            out.append({"conv_id": conv_id, "place": place, "role": role, "text": text})
            if len(out) >= 500:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        for _ in rows:
            pass
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with faults that their ``conv_id:turn`` decides: ``conv_id``, ``turn``, ``role``, ``text``, ``lost``.

    By the remainder of its crc32 by 20, a row is lost (0; it stays, marked, so that its
    conversation does), loses its text (1) or the marks ``.!?`` (2), is repeated (3) or
    said by the user (4). Null values count as one blank.
    """
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank(conv_id), F.lit(":"), blank(turn))) % 20
    value = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank(text), "[.!?]", "")).otherwise(blank(text))
    return df.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(blank(role)).alias("role"),
        F.when(fault != 0, value).alias("text"),
        (fault == 0).alias("lost"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(df: DataFrame, conv_id: str, turn: str, role: str, text: str, lost: str | None) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    gone: Column = F.coalesce(F.col(f"`{lost}`").cast("boolean"), F.lit(False)) if lost else F.lit(False)
    return df.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        blank(role).alias("role"),
        blank(text).alias("text"),
        gone.alias("lost"),
    )


def _with_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of the conversations in ``audits``, in order, each conversation's audit first."""
    wanted = audits.select(F.col("conv_id").alias("_wanted"))
    own = rows.where("NOT lost").join(wanted, F.col("conv_id").eqNullSafe(F.col("_wanted")), "left_semi")
    own = own.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    first = audits.select(
        "conv_id",
        F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("turn"),
        F.lit("").alias("role"),
        F.lit("").alias("text"),
        "audit",
    )
    both = first.unionByName(own).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "kind", "turn", "role", "text").select("conv_id", "role", "text", "audit")


def repair(
    df: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    lost: str | None = None,
    held: int = HELD_CHARACTERS,
) -> DataFrame:
    """Faults of each conversation, and the cheapest edits that mend it.

    Rows are taken by turn, nulls first, then by role and text. A row's first fault counts: it is
    blank, a duplicate of an earlier row, or truncated (its last character that is no white space is not
    one of ``.!?``). Edits: a row is kept (cost 0), gets another role of user and assistant (3) or
    is deleted (4; blank and duplicate rows must be), and rows without text are
    inserted (3); a truncated row that stays costs 3 more. The roles' initials that are left
    must be ``s?(ua)+`` or nothing. See :func:`cheapest_edits` for the search.

    Result, a row for each id: ``conv_id``, ``gaps`` (turns that no row has between the first and the last),
    ``blank``, ``duplicate``, ``truncated``, ``illegal`` (neighbours whose initials are not su, ua or au), ``cost``,
    ``audit`` (initials of the edits, the least of the cheapest) and ``repaired_sha256`` of the
    lines ``role:text``. A null role or text counts as one blank, so such a text is blank; a
    role without characters has no initial and cannot be kept; rows with a null id are one conversation.
    Rows marked ``lost`` count for nothing but keep their conversation in the result. Repeated rows
    are duplicates. No rows give no rows. Only the named columns are read.

    A conversation is read as a stream. What is held of it are a byte, a digest and the lattice's
    nodes for each row, and its texts up to ``held`` characters. A longer one is
    streamed once more, to be digested by its edits, so its texts are never in memory as a
    whole. Its audit, one value of the result, is as long as it has rows, and its digest is of one
    sequence: a conversation is not split.
    """
    rows = _rows(df, conv_id, turn, role, text, lost)
    names = ["conv_id", "turn", "role", "text", "lost"]
    found = _sorted(rows.select(*names)).mapInArrow(lambda it: _judged(it, held), "conv_id long, " + COUNTS)
    found = written(found, "conversations-edits")
    long = found.where("repaired_sha256 IS NULL")
    if long.isEmpty():
        return found
    digests = _with_audits(rows, long).mapInArrow(lambda it: _replayed(it, True), "conv_id long, repaired_sha256 string")
    digests = digests.select(F.col("conv_id").alias("_id"), F.col("repaired_sha256").alias("_digest"))
    joined = found.join(digests, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    whole = F.coalesce("repaired_sha256", "_digest").alias("repaired_sha256")
    return joined.select(*[c for c in found.columns if c != "repaired_sha256"], whole)


def repaired(
    df: DataFrame,
    edits: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    lost: str | None = None,
) -> DataFrame:
    """The rows that the edits of :func:`repair` leave: ``conv_id``, ``place`` (from 0), ``role``, ``text``."""
    rows = _rows(df, conv_id, turn, role, text, lost)
    made = _with_audits(rows, edits.select("conv_id", "audit"))
    return made.mapInArrow(lambda it: _replayed(it, False), "conv_id long, role string, place long, text string").select(
        "conv_id", "place", "role", "text"
    )
