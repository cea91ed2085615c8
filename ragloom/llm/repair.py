"""Conversation structure repair by aligning turns with the grammar ``(s?(ua)+)?``.

Edits of a turn: Keep (0), Rerole to user or assistant (2), Delete (3; blank and duplicate
turns must go), Insert of an empty user or assistant turn (2); a truncated turn that is
not deleted adds 1. Of the cheapest edit strings the ASCII-least is taken.

The grammar has one string of each feasible length, and all of them end alike (...uaua).
So one Wagner-Fischer table over (turns left, letters left) holds the alignment with
every length; it is kept in an Ukkonen band whose width follows from the cost of an
incumbent (a greedy repair). The cheapest lengths are backtraced and their audits
compared.

Long conversations are cut into blocks of ``BLOCK`` turns. A block is aligned for each of
the four places in the grammar where it can begin (nothing yet, after s, after u, after a)
and end; only these 4 x 4 costs are chained, first backwards (what each end costs from
there on), then forwards (where each block begins), so tables and backtraces of one
conversation run in parallel and no task holds a conversation. Turns pass in order in a
stream: once range-sorted, once by conversation at the end, as the hash of a
conversation's text has to read it in sequence.

Results: null ids are one conversation, null turns come first, turns with equal numbers
are ordered by role and text; a null role or text counts as one space. Conversations
without rows get zeros, an empty audit and the hash of the empty string.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs_of, written

DELETE, INSERT, REROLE, LATE = 3, 2, 2, 1
#: Turns aligned as one block.
BLOCK = 256
#: What another begin and end in the grammar can add to the incumbent's cost.
SLACK = 16
NEVER = 1 << 40
#: Places in the grammar, and what completes it from there.
BEGIN, SYSTEM, USER, DONE = range(4)
TAIL = ("", "ua", "a", "")
END_COST = tuple(INSERT * len(t) for t in TAIL)
ROLES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---- one block


def _incumbent(classes: str, faults: str) -> int:
    """Cost of a greedy repair that begins and ends after an assistant turn."""
    cost, want = 0, "u"
    for c, f in zip(classes, faults):
        if f in "bp":
            cost += DELETE
            continue
        cost += (0 if c == want else REROLE) + (f == "t") * LATE
        want = "a" if want == "u" else "u"
    return cost + (want == "a") * INSERT


class _Table:
    """Alignment costs of one block: ``grid[i][e][k]`` for the turns from i on against the
    last r letters of a string that ends with an assistant (e = 0) or user turn (e = 1),
    r = k - low + (n - i); ``before[i][e][k]`` with a system turn still to keep."""

    def __init__(self, classes: str, faults: str):
        n = self.n = len(classes)
        bound = _incumbent(classes, faults) + SLACK
        self.low, high = bound // DELETE + 1, bound // INSERT + 1
        w = self.width = self.low + high + 1
        self.classes, self.faults = classes, faults
        grid = np.full((n + 1, 2, w + 1), NEVER, np.int64)
        before = grid.copy()
        grid[n, :, self.low] = 0
        slope = INSERT * np.arange(w)
        for i in range(n - 1, -1, -1):
            left = np.arange(w) - self.low + (n - i)
            base = DELETE + grid[i + 1, :, 1:]
            before[i, :, :w] = DELETE + before[i + 1, :, 1:]
            if faults[i] not in "bp":
                late = LATE if faults[i] == "t" else 0
                cost = {c: late + (0 if classes[i] == c else REROLE) for c in "ua"}
                odd = (left & 1).astype(bool)
                meet = np.stack([np.where(odd, cost["a"], cost["u"]),
                                 np.where(odd, cost["u"], cost["a"])]) + grid[i + 1, :, :w]
                meet[:, left < 1] = NEVER
                base = np.minimum(base, meet)
                if classes[i] == "s":
                    before[i, :, :w] = np.minimum(before[i, :, :w],
                                                  late + grid[i + 1, :, 1:])
            base[:, left < 0] = NEVER
            grid[i, :, :w] = np.minimum.accumulate(base - slope, axis=1) + slope
        self.grid, self.before = grid, before

    def ends(self, begin: int):
        """(cost, end, letters, e, system first) of every alignment from ``begin``."""
        n, w = self.n, self.width
        if begin == BEGIN:
            yield DELETE * n, BEGIN, 0, 0, None
        if begin == SYSTEM:
            yield DELETE * n, SYSTEM, 0, 0, False
        for k in range(w):
            r = k - self.low + n
            if r < 0:
                continue
            for e in (0, 1):
                first_is_user = (r % 2 == 0) == (e == 0)
                end = USER if e else DONE
                if begin == BEGIN and first_is_user:
                    yield int(self.before[0, e, k]), SYSTEM if r == 0 else end, r, e, True
                if first_is_user == (begin != USER) and (r > 0 or begin in (USER, DONE)
                                                         and end == begin):
                    yield int(self.grid[0, e, k]), end, r, e, False

    def costs(self) -> list[int]:
        """4 x 4 costs by begin and end."""
        out = [NEVER] * 16
        for begin in range(4):
            for cost, end, *_ in self.ends(begin):
                out[4 * begin + end] = min(out[4 * begin + end], cost)
        return out

    def audit(self, r: int, e: int, system: bool | None) -> str:
        """ASCII-least backtrace of the alignment with r letters."""
        n, low = self.n, self.low
        if not (r or system):
            return "D" * n
        out, i = [], 0
        while i < n:
            k = r - (n - i) + low
            table = self.before if system else self.grid
            here = table[i, e, k]
            if here == DELETE + table[i + 1, e, k + 1]:
                out.append("D")
                i += 1
            elif system:
                out.append("K")
                system, i = False, i + 1
            elif r and k and here == INSERT + self.grid[i, e, k - 1]:
                out.append("I")
                r -= 1
            else:
                letter = "a" if (r % 2 == 1) == (e == 0) else "u"
                out.append("K" if self.classes[i] == letter else "R")
                i, r = i + 1, r - 1
        return "".join(out)

    def best(self, begin: int, ahead: tuple[int, ...]) -> tuple[str, int]:
        """(ASCII-least cheapest audit, end) from ``begin``, given what each end costs."""
        found = [(cost + ahead[end], end, *rest) for cost, end, *rest in self.ends(begin)]
        least = min(f[0] for f in found)
        return min((self.audit(*rest), end) for cost, end, *rest in found if cost == least)


@lru_cache(maxsize=20_000)
def _short_costs(classes: str, faults: str) -> list[int]:
    return _Table(classes, faults).costs()


@lru_cache(maxsize=20_000)
def _short_best(classes: str, faults: str, begins: tuple, ahead: tuple) -> tuple:
    table = _Table(classes, faults)
    return tuple(table.best(b, ahead) for b in begins)


def block_costs(classes: str, faults: str) -> list[int]:
    if len(classes) <= 32:
        return _short_costs(classes, faults)
    return _Table(classes, faults).costs()


def block_audits(classes: str, faults: str, begins: tuple, ahead: tuple) -> tuple:
    """(audit, end) for each begin; ``ahead`` is what each end costs from there on."""
    low = min(ahead)
    ahead = tuple(a - low for a in ahead)
    if len(classes) <= 32:
        return _short_best(classes, faults, begins, ahead)
    table = _Table(classes, faults)
    return tuple(table.best(b, ahead) for b in begins)


# ---- streams


def _emit(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _stream(df: DataFrame, step, ddl: str) -> DataFrame:
    """``mapInArrow`` of a generator of rows over runs of equal conversation ids."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        held, size = [], 0
        for (conv,), rows in runs_of(batches, 1):
            for row in step(conv, rows):
                held.append(row)
                size += 64 + sum(len(x) for x in row if isinstance(x, str))
                if size > 1 << 20:
                    yield _emit(held, schema)
                    held, size = [], 0
        if held:
            yield _emit(held, schema)

    return df.mapInArrow(run, ddl)


def _cut(conv, rows):
    """Blocks of a run of turns: first place, classes, faults, 4 x 4 costs."""
    at, classes, faults = None, [], []
    for _, place, initial, fault in rows:
        if at is not None and len(classes) == BLOCK:
            yield _block(conv, at, classes, faults)
            at = None
        if at is None:
            at, classes, faults = place, [], []
        classes.append(initial)
        faults.append(fault)
    yield _block(conv, at, classes, faults)


def _block(conv, at, classes, faults):
    classes, faults = "".join(classes), "".join(faults)
    return conv, at, classes, faults, block_costs(classes, faults)


def _backwards(conv, blocks):
    """Blocks from the last to the first, with what each end of theirs costs."""
    ahead, held = END_COST, None
    for _, _, at, classes, faults, costs in blocks:
        if held:
            yield (*held, False)
        held = conv, at, classes, faults, list(ahead)
        ahead = tuple(min(costs[4 * b + e] + ahead[e] for e in range(4)) for b in range(4))
    yield (*held, True)


def _backtraced(conv, blocks):
    for _, at, classes, faults, ahead, first in blocks:
        begins = (BEGIN,) if first else (BEGIN, SYSTEM, USER, DONE)
        found = block_audits(classes, faults, begins, tuple(ahead))
        yield conv, at, faults, [a for a, _ in found], [e for _, e in found]


def _forwards(conv, rows):
    """Turns in order with their edits: (conv, turn, initial, fault, edit, role, text)."""
    state, edits, faults = BEGIN, iter(""), iter("")
    place = BEGIN  # in the grammar, letter by letter
    for _, _, is_turn, turn, initial, role, text, block_faults, audits, ends in rows:
        if not is_turn:
            edits, faults = iter(audits[state]), iter(block_faults)
            state = ends[state]
            continue
        edit = next(edits)
        while edit == "I":
            letter = "a" if place == USER else "u"
            place = USER if letter == "u" else DONE
            yield conv, None, "", "", "I", ROLES[letter], ""
            edit = next(edits)
        if edit != "D":
            letter = initial if place == BEGIN and edit == "K" else "a" if place == USER else "u"
            place = {"s": SYSTEM, "u": USER, "a": DONE}[letter]
            if edit == "R":
                role = ROLES[letter]
        yield conv, turn, initial, next(faults), edit, role, text
    for letter in TAIL[place]:
        yield conv, None, "", "", "I", ROLES[letter], ""


def _digest(conv, rows):
    """One row per conversation from its edited turns, read in order."""
    audit, sha, wrote = [], hashlib.sha256(), False
    faults, illegal, cost = {"b": 0, "p": 0, "t": 0, "-": 0, "": 0}, 0, 0
    last, low, high, distinct = "", None, None, 0
    for _, turn, initial, fault, edit, role, text in rows:
        audit.append(edit)
        if edit != "I":
            faults[fault] += 1
            illegal += bool(last) and last + initial not in ("su", "ua", "au")
            last = initial
            if turn is not None and turn != high:
                low, high, distinct = turn if low is None else low, turn, distinct + 1
        cost += DELETE if edit == "D" else (INSERT if edit == "I" else REROLE if edit == "R"
                                            else 0) + (fault == "t") * LATE
        if edit != "D":
            sha.update((("\n" if wrote else "") + f"{role}:{text}").encode())
            wrote = True
    gaps = int(high - low) + 1 - distinct if distinct else 0
    yield (conv, gaps, faults["b"], faults["p"], faults["t"], illegal, cost, "".join(audit),
           sha.hexdigest())


# ---- tables


def damaged(turns: DataFrame) -> DataFrame:
    """The conversations table with the given faults put in, by crc32 of id and turn."""
    nulls = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")}
    fate = F.crc32(F.concat(nulls["conv_id"], F.lit(":"), nulls["turn"])) % 20
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text"), F.lit(" ")).alias("text"), fate.alias("_fate"))
    rows = rows.where("_fate != 0").select(
        "conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fate") == 3, 2).otherwise(1))).alias("_"))
    return rows.drop("_")


def _faults(turns: DataFrame) -> DataFrame:
    """(_c, _at, _initial, _fault): first fault of each placed turn, b, p, t or -."""
    end = F.rtrim(F.col("_text"), F.lit(WHITE))
    own = (F.when(F.length(end) == 0, "b")
           .when(F.substring(end, -1, 1).isin(".", "!", "?"), "-").otherwise("t"))
    first = F.substring("_role", 1, 1)
    slim = turns.select(
        "_c", "_at", F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("_initial"),
        own.alias("_own"), F.unhex(F.sha2(F.concat_ws(
            ":", F.length("_role").cast("string"), "_role", "_text"), 256)).alias("_digest"))
    # the first place of each text, aggregated before the shuffle; joined by place, which
    # is unique, so a text that fills a conversation is no hot key
    firsts = slim.groupBy("_c", "_digest").agg(F.min("_at").alias("_at")).select(
        "_at", F.lit(True).alias("_first"))
    return slim.join(firsts, "_at", "left").select(
        "_c", "_at", "_initial",
        F.when(F.col("_own") == "b", "b").when(F.col("_first").isNull(), "p")
        .otherwise(F.col("_own")).alias("_fault"))


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every turn with its edit, and the inserted ones: (_c, _turn, _initial, _fault, edit,
    role, text); a conversation's rows lie in one partition, in order. ``_fault`` is b
    (blank), p (duplicate), t (truncated), - (none) or empty (inserted)."""
    plain = turns.select(
        F.col(f"`{conv_col}`").alias("_c"), F.col(f"`{turn_col}`").alias("_turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("_text"))
    order = ["_c", F.col("_turn").asc_nulls_first(), "_role"]
    placed = written(
        plain.repartitionByRange(*order, F.substring("_text", 1, 64))
        .sortWithinPartitions(*order, "_text")
        .withColumn("_at", F.monotonically_increasing_id()), "turns")
    kind = placed.schema["_c"].dataType.simpleString()
    number = placed.schema["_turn"].dataType.simpleString()

    facts = (_faults(placed).repartition(F.shiftright("_at", 33)).sortWithinPartitions("_at"))
    blocks = written(_stream(facts, _cut, f"_c {kind}, _at long, _classes string, "
                             "_faults string, _costs array<long>"), "blocks")
    back = _stream(
        blocks.select("_c", F.negative("_at").alias("_back"), "_at", "_classes", "_faults",
                      "_costs").repartition("_c").sortWithinPartitions("_c", "_back"),
        _backwards, f"_c {kind}, _at long, _classes string, _faults string, "
        "_ahead array<long>, _begins boolean")
    audits = _stream(back.repartition("_c", "_at").sortWithinPartitions("_c", "_at"),
                     _backtraced, f"_c {kind}, _at long, _faults string, "
                     "_audits array<string>, _ends array<int>")
    first = F.substring("_role", 1, 1)
    merged = placed.select(
        "_c", "_at", F.lit(True).alias("_is_turn"), "_turn",
        F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("_initial"),
        "_role", "_text").unionByName(
        audits.withColumn("_is_turn", F.lit(False)), allowMissingColumns=True)
    return _stream(
        merged.repartition("_c").sortWithinPartitions("_c", "_at", "_is_turn"), _forwards,
        f"_c {kind}, _turn {number}, _initial string, _fault string, edit string, "
        "role string, text string")


def repair(turns: DataFrame, ids: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for every distinct id of ``ids``: what was wrong, the audit and the digest
    of the repaired conversation."""
    edited = repaired_turns(turns, conv_col, turn_col, role_col, text_col)
    kind = edited.schema["_c"].dataType.simpleString()
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    digests = _stream(edited, _digest, f"_c {kind}, " + ", ".join(f"{c} long" for c in longs)
                      + ", audit string, repaired_sha256 string")
    every = ids.select(F.col(f"`{conv_col}`").alias("_id")).distinct()
    return every.join(digests, F.col("_id").eqNullSafe(F.col("_c")), "left").select(
        F.col("_id").alias(conv_col),
        *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in longs],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
