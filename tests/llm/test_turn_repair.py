"""Conversation repair against a plain search over whole conversations."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.helpers import rows_of
from tsforge.llm import turn_repair as repair

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    # Names that the operator uses inside or returns.
    *(T.StructField(n, T.StringType()) for n in ("conv", "at", "audit", "part", "chunk", "copies", "state")),
])
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA).repartition(3)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    def put(state, initial):
        """The state after putting out a row, None where that is not allowed."""
        return initial if (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")} else None

    def better(best, state, entry):
        if state is not None and (state not in best or entry[:2] < best[state][:2]):
            best[state] = entry
            return True
        return False

    def with_inserts(best):
        work = list(best)
        while work:
            state = work.pop()
            cost, audit, lines = best[state]
            for role in ("user", "assistant"):
                after = put(state, role[0])
                if better(best, after, (cost + 3, audit + "I", [*lines, role + ":"])):
                    work.append(after)
        return best

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in with_inserts(best).items():
            better(after, state, (cost + 4, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                cut = 3 if fault else 0
                better(after, put(state, role[:1]), (cost + cut, audit + "K", [*lines, f"{role}:{text}"]))
                for new in ("user", "assistant"):
                    better(after, put(state, new[0]), (cost + cut + 3, audit + "R", [*lines, f"{new}:{text}"]))
        best = after
    ends = [v for s, v in with_inserts(best).items() if s in ("", "a")]
    cost, audit, lines = min(ends, key=lambda x: x[:2])
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows):
    left = plain_damage(rows)
    return sorted(
        ((c, *plain_repair([r[1:] for r in left if r[0] == c])) for c in {r[0] for r in rows}), key=repr
    )


def conversations():
    rnd = random.Random(1)
    rows = []
    for conv in range(60):
        order = ["system", "user", "assistant"]
        for turn in range(rnd.choice([0, 1, 2, 5, 9, 40])):
            role = rnd.choice([*order, order[1 + turn % 2], order[1 + turn % 2], "", "User", "sage", None, "ü"])
            text = rnd.choice(["Yes.", "No!", "And then", "", " \n", "What? \t", None, "ünd.", f"word {turn}.", f"cut {turn}"])
            rows.append((conv, rnd.choice([turn, turn, turn + 3, None]), role, text))
    rows += [(None, t, r, "Same.") for t, r in [(0, "user"), (1, "assistant"), (None, "user"), (None, None)]]
    rows += [(-5, 3, "user", "x" * 100_000 + "."), (-5, 4, "assistant", "y."), (-5, 4, "assistant", "y."), (-5, 4, "assistant", "y.")]
    rows += [(-6, None, "user", "a."), (-6, None, "assistant", "b")] * 3
    rows += [(900 + i, 0, "user", "One row.") for i in range(25)]
    return rows


@pytest.mark.parametrize("chunk, passes", [(1_024, 4), (3, 4), (1, 0)])
def test_repair(spark, chunk, passes):
    rows = conversations()
    got = repair.repair_report(frame(spark, rows), chunk, passes)
    assert got.columns == ["conv_id", *NAMES]
    assert rows_of(got) == plain(rows)


@pytest.mark.parametrize("passes", [2, 60])
def test_paths_that_never_meet(spark, passes):
    """Truncated rows of no use are all deleted from any state: a chunk tells nothing about the next one."""
    rows = [(1, 0, "user", "Begin.")] + [(1, t, "system", f"cut {t}") for t in range(1, 120)] + [(1, 120, "assistant", "End.")]
    rows += [(2, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(150)]
    got = repair.repair_report(frame(spark, rows), 8, passes)
    assert rows_of(got) == plain(rows)


def test_no_rows(spark):
    assert repair.repair_report(frame(spark, [])).count() == 0
    gone = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256().hexdigest()
    assert rows_of(repair.repair_report(frame(spark, [(7, gone, "user", "x")]))) == [(7, 0, 0, 0, 0, 0, 0, "", empty)]


def test_a_long_conversation_spreads(spark):
    """Chunks of a conversation that holds most rows lie in several ranges; its repeated rows are merged first."""
    rows = [(1, t, ["user", "assistant"][t % 2], "The same text." if t % 3 else f"Text {t}.") for t in range(4_000)]
    rows += [(1, 7, "user", "x.")] * 500 + [(2, 0, "user", "a.")]
    ordered = repair.turns(repair.damaged(frame(spark, rows)), 64)
    spread = ordered.filter("conv.conv_id = 1").groupBy("part", "chunk").count()
    assert spread.agg(F.max("count")).first()[0] <= 64
    assert spread.select("part").distinct().count() > 1
    assert rows_of(repair.repair_report(frame(spark, rows), 64)) == plain(rows)
