"""Conversation repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from ragloom.llm import repair

SF = "/root/testdata/sf0.001"


def cheapest(classes, faults):
    """(cost, ASCII-least audit) by a search over single edits."""
    n, best, todo = len(classes), {}, [(0, "", 0, "")]
    while todo:
        cost, audit, i, last = heapq.heappop(todo)
        if (i, last) in best:
            continue
        best[i, last] = cost, audit
        if i == n and last in ("", "a"):
            return cost, audit
        letter = "a" if last == "u" else "u"
        heapq.heappush(todo, (cost + 2, audit + "I", i, letter))
        if i < n:
            heapq.heappush(todo, (cost + 3, audit + "D", i + 1, last))
            if faults[i] not in "bp":
                late = faults[i] == "t"
                if last == "" and classes[i] == "s":
                    heapq.heappush(todo, (cost + late, audit + "K", i + 1, "s"))
                keep = classes[i] == letter
                heapq.heappush(todo, (cost + late + (0 if keep else 2),
                                      audit + ("K" if keep else "R"), i + 1, letter))


def chained(classes, faults, size):
    cuts = [(classes[i:i + size], faults[i:i + size]) for i in range(0, len(classes), size)]
    ahead, costs = repair.END_COST, []
    for c, f in reversed(cuts):
        costs.append(ahead)
        m = repair.block_costs(c, f)
        ahead = tuple(min(m[4 * b + e] + ahead[e] for e in range(4)) for b in range(4))
    state, out = repair.BEGIN, ""
    for (c, f), after in zip(cuts, reversed(costs)):
        audit, state = repair.block_audits(c, f, (0, 1, 2, 3), after)[state]
        out += audit
    return ahead[0], out + "I" * len(repair.TAIL[state])


def test_alignment_equals_search():
    rnd = random.Random(3)
    for _ in range(700):
        n, letters = rnd.randint(1, 13), rnd.choice(["ua", "sua", "suao", "o", "s", "uuua"])
        marks = rnd.choice(["----bpt", "bp", "t-", "bbbbb-"])
        classes = "".join(rnd.choice(letters) for _ in range(n))
        faults = "".join(rnd.choice(marks) for _ in range(n))
        for size in (100, 1, 4):
            assert chained(classes, faults, size) == cheapest(classes, faults)


def brute(turns):
    """The contract, row by row, over (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in turns:
        convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub(r"[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), ""
        for _, role, text in rows:
            shown = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults += ("b" if not shown else "p" if (role, text) in seen
                       else "t" if shown[-1] not in ".!?" else "-")
            seen.add((role, text))
        first = [r[1][:1] for r in rows]
        cost, audit = cheapest([c if c in ("s", "u", "a") else "o" for c in first], faults)
        told, place, todo = [], "", iter(rows)
        for edit in audit:
            letter = "a" if place == "u" else "u"
            if edit == "I":
                told.append(("user" if letter == "u" else "assistant") + ":")
            else:
                _, role, text = next(todo)
                if edit == "D":
                    continue
                if edit == "R":
                    role = "user" if letter == "u" else "assistant"
                elif role[:1] == "s":
                    letter = "s"
                told.append(f"{role}:{text}")
            place = letter
        turns_seen = {r[0] for r in rows if r[0] is not None}
        out[conv] = (max(turns_seen) - min(turns_seen) + 1 - len(turns_seen) if turns_seen else 0,
                     *(faults.count(x) for x in "bpt"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])),
                     cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest())
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_repair_equals_brute_force(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    result = repair.repair(repair.damaged(turns), turns)
    assert result.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal",
                              "cost", "audit", "repaired_sha256"]
    assert got(result) == brute([(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()])


ODD = "conv_id long, turn long, role string, text string, _c int, _at string, edit int"


@pytest.fixture(scope="module")
def odd_rows():
    rnd = random.Random(5)
    rows = [(None, None, None, None), (None, 1, "user", "no id."), (1, None, "user", "hi."),
            (1, None, None, "x"), (1, 5, "assistant", None), (2, 0, "", ""), (3, 0, "user", "a."),
            (3, 0, "user", "a."), (3, 0, "assistant", "b!"), (3, 9, "tool", "word " * 60_000),
            (4, 0, "system", "s."), (5, 0, "system", "s."), (5, 1, "system", "s."),
            (6, 0, "ünser", "ü?"), (6, 1, "unknown", "z:\n \x0b")]
    rows += [(7, i, rnd.choice(["user", "user", "assistant", "tool"]),
              rnd.choice(["yes.", "no", f"t{i}.", f"t{i}", " "])) for i in range(900)]
    rows += [(8, 3, "user", "same.")] * 400
    return rows


def test_repair_odd(spark, odd_rows):
    turns = spark.createDataFrame([(*r, 1, "x", 2) for r in odd_rows], ODD)
    assert got(repair.repair(repair.damaged(turns), turns)) == brute(odd_rows)
    none = turns.limit(0)
    assert repair.repair(repair.damaged(none), none).count() == 0
    assert got(repair.repair(none, turns))[7] == (0,) * 6 + ("", repair.EMPTY_SHA)


def test_repaired_turns_are_legal(spark, odd_rows):
    turns = spark.createDataFrame([(*r, 1, "x", 2) for r in odd_rows], ODD)
    kept = defaultdict(str)
    for r in repair.repaired_turns(turns).where("edit != 'D'").collect():
        kept[r._c] += r.role[:1]
    assert all(re.fullmatch(r"(s?(ua)+)?", k) for k in kept.values())
