"""Repaired conversations against trying the edits in plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import conversations, queries
from tests.compare import TESTDATA

FOLDER = str(TESTDATA / "sf0.001")
SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, rows) by every partial repair that is the best of its kind, row by row."""

    def inserted(found):
        for _ in range(2):  # two inserted rows in a row reach every state
            for legal, (cost, audit, made) in list(found.items()):
                role = "assistant" if legal.endswith("u") else "user"
                new = (cost + 3, audit + "I", [*made, (role, "")])
                key = (legal + role[0])[-2:]
                if key not in found or new[:2] < found[key][:2]:
                    found[key] = new
        return found

    now = inserted({"": (0, "", [])})
    for (role, text), fault in zip(rows, faults, strict=True):
        following = {}

        def put(key, new, following=following):
            if key not in following or new[:2] < following[key][:2]:
                following[key] = new

        for legal, (cost, audit, made) in now.items():
            put(legal, (cost + 4, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            other = "assistant" if legal.endswith("u") else "user"
            put((legal + other[0])[-2:], (cost + 3 + more, audit + "R", [*made, (other, text)]))
            initial = role[:1]
            if legal + initial in ("s", "u", "su", "ua", "au", "aua", "uau", "sua") or (legal + initial)[-2:] in ("ua", "au", "su"):
                if initial and (legal == "" and initial in "su" or (legal[-1:] + initial) in ("su", "ua", "au")):
                    put((legal + initial)[-2:], (cost + more, audit + "K", [*made, (role, text)]))
        now = inserted(following)
    ends = [v for legal, v in now.items() if legal == "" or legal.endswith("a")]
    return min(ends, key=lambda v: v[:2])


def brute(rows):
    out = {}
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted(
            (r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
        )
        seen, faults = set(), []
        for _, _, role, text in own:
            last = re.findall("[^ \t-\r]", text)
            if not last:
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append("fine" if last[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] or " " for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, made = cheapest([r[2:] for r in own], faults)
        assert LEGAL.fullmatch("".join(r[:1] for r, _ in made))
        whole = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        counts = tuple(faults.count(k) for k in ("blank", "duplicate", "truncated"))
        out[conv] = (gaps, *counts, illegal, cost, audit, whole)
    return out


def odd(seed, n=150):
    rng = random.Random(seed)
    out = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["system", "user", "assistant", "tool", None, "", "userX"]) if rng.random() < 0.4 else ["user", "assistant"][turn % 2]
            text = rng.choice([None, "", " \t\n", "Yes.", "Yes.", "No!  ", "and so", "Été?\n", "日本", f"t{rng.random()}."])
            out.append((conv, rng.choice([turn, turn, turn * 2, None, 0]), role, text))
    return out + out[:3]


@pytest.mark.parametrize("held", [0, 10, 1 << 20])
def test_repairs_equal_brute_force(spark, held):
    given = odd(held)
    df = spark.createDataFrame(given, SCHEMA).withColumns({c: F.lit("own") for c in ("lost", "audit", "kind", "copy", "a.b", "cost")})
    damaged = conversations.damaged(df)
    edits = conversations.repair(damaged, lost="lost", held=held)
    found = {r[0]: tuple(r)[1:] for r in edits.collect()}
    assert found == brute(given)
    made = {}
    for r in conversations.repaired(damaged, edits, lost="lost").orderBy("conv_id", "place").collect():
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    empty = hashlib.sha256(b"").hexdigest()
    digests = {conv: hashlib.sha256("\n".join(lines).encode()).hexdigest() for conv, lines in made.items()}
    assert {c: digests.get(c, empty) for c in found} == {c: row[-1] for c, row in found.items()}


def test_query_equals_brute_force(spark):
    given = [tuple(r) for r in queries.table(spark, FOLDER, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op13_conversation_repair(spark, FOLDER)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == brute(given)


def test_long_conversations_and_empty_tables(spark):
    rng = random.Random(4)
    given = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["So.", "so", f"{k}!"])) for k in range(3000)]
    df = spark.createDataFrame(given, SCHEMA)
    found = conversations.repair(conversations.damaged(df), lost="lost", held=100)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == brute(given)
    assert conversations.repair(conversations.damaged(df.where("false"))).count() == 0


def test_search_ends_where_the_heaps_meet():
    """The forward search alone would settle all nodes; the two together settle about as many as one path needs."""
    cost, audit = conversations.cheapest_edits(conversations.Lattice("ua" * 50, bytes(100)))
    assert (cost, audit) == (0, "K" * 100)
    assert conversations.cheapest_edits(conversations.Lattice("", b"")) == (0, "")
    assert conversations.cheapest_edits(conversations.Lattice("s", b"\0")) == (4, "D")
    assert conversations.cheapest_edits(conversations.Lattice("u", b"\0")) == (3, "KI")
