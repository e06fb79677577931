"""Conversation structure repair by iterative-deepening A*.

A conversation's rows are kept, given another role or deleted, and empty turns are inserted, until the roles read: system once at
most, then user and assistant in turn. A depth-first search tries the edits in ASCII order under a cost bound that grows to the
least cost it was cut off at; what a place in the conversation could not reach with how much left is kept in a table of failed
states. The first accepting path is the cheapest, and of those the least in ASCII order.

Conversations of more than ``WHOLE`` rows are cut into pieces of ``PIECE``. A piece is searched for each state it can be entered and left in; the results of
neighbouring pieces join by the cheapest state between them, so long conversations cost no more a row. Every piece ends with an edit
of a row, so no audit is the beginning of another and the least of a whole is made of the least of its parts.

Conversations of up to ``LONG`` rows and ``LONG_CHARS`` characters are read whole, many to a task. Longer ones are sorted by range
over as many tasks as there are, which search stretches of them; only a stretch's costs meet in one task. The digest of a
conversation's text is by its nature made from start to end: a task streams the stretches through it and holds one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, slices, stored

# Rows of a conversation that is searched as one, and of a piece of a longer one.
WHOLE, PIECE = 16, 4
# Rows and characters of a conversation that one task may hold, and of a stretch of a longer one.
LONG, LONG_CHARS = 512, 1 << 22
# Costs of the edits and of a truncated row that stays, edits, roles and ends of sentences.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
ROLES, ENDS = ("user", "assistant"), ".!?"
# States: nothing yet, after system, after user, after assistant. Where a role's initial leads, what is missing, what accepts.
START, OPENED, ASKED, ANSWERED = range(4)
NEXT = {(START, "s"): OPENED, (START, "u"): ASKED, (OPENED, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
GIVEN = (ASKED, ASKED, ANSWERED, ASKED)
TRAIL = ("", "II", "I", "")
BAD = 1 << 40

Matrix = dict[tuple[int, int], tuple[int, str]]


def code(initial: str, blank: bool, duplicate: bool, truncated: bool) -> str:
    """One character for what the search sees of a row: ``-`` if it must go, else its initial, upper case if truncated."""
    if blank or duplicate:
        return "-"
    seen = initial if initial in ("s", "u", "a") else "x"
    return seen.upper() if truncated else seen


def bounds(codes: str) -> list[int]:
    """Least cost of the rows from each place on: what faults cost, and half of what each illegal neighbourhood costs at least.

    An edit of a row mends two neighbourhoods at most. Deleting a truncated row costs one more than keeping it.
    """
    faults, halves, after = 0, 0, ""
    out = [0]
    for c in reversed(codes):
        if c == "-":
            faults += DELETE
        else:
            faults += CUT if c.isupper() else 0
            if after and (c + after).lower() not in ("su", "ua", "au"):
                halves += DELETE - CUT if c.isupper() or after.isupper() else REROLE
            after = c
        out.append(faults + (halves + 1) // 2)
    return out[::-1]


@lru_cache(1 << 16)
def cheapest(codes: str, enter: int, leave: int | None) -> tuple[int, str] | None:
    """Cost and edits of the best path over the rows from state ``enter`` to ``leave``; None if there is none.

    Without ``leave`` the path ends in an accepting state, and turns may be inserted after the last row.
    """
    least, n = bounds(codes), len(codes)
    failed: dict[tuple[int, int], int] = {}
    over = BAD

    def descend(i: int, state: int, left: int) -> str | None:
        nonlocal over
        if least[i] > left:
            over = min(over, least[i] - left)
            return None
        if i == n:
            if state == leave or (leave is None and not TRAIL[state]):
                return ""
            if leave is not None:
                return None
        if failed.get((i, state), -1) >= left:
            return None
        row = codes[i] if i < n else ""
        stay = CUT if row.isupper() else 0
        moves = [("D", i + 1, state, DELETE)] if row else []
        moves.append(("I", i, GIVEN[state], INSERT))
        if row and row != "-":
            if (state, row.lower()) in NEXT:
                moves.append(("K", i + 1, NEXT[state, row.lower()], stay))
            moves.append(("R", i + 1, GIVEN[state], REROLE + stay))
        for edit, j, after, cost in moves:
            if cost > left:
                over = min(over, cost - left)
                continue
            rest = descend(j, after, left - cost)
            if rest is not None:
                return edit + rest
        failed[i, state] = left
        return None

    bound = least[0]
    # Deleting all rows and inserting a pair reaches every state that can be reached, so no bound need be higher.
    most = (DELETE + CUT) * n + 4 * INSERT
    while bound <= most:
        over = BAD
        found = descend(0, enter, bound)
        if found is not None:
            return bound, found
        bound += max(1, min(over, most)) if over < BAD else 1
    return None


def matrix(codes: str) -> Matrix:
    """Cost and audit of rows for each state they are entered and left in; pieces are joined from left to right."""
    whole: Matrix | None = None
    for start in range(0, len(codes), PIECE):
        piece = codes[start : start + PIECE]
        found = {(q, r): cheapest(piece, q, r) for q in range(4) for r in range(4)}
        part = {k: v for k, v in found.items() if v is not None}
        whole = part if whole is None else joined(whole, part)
    return whole if whole is not None else {(q, q): (0, "") for q in range(4)}


def joined(one: Matrix, two: Matrix) -> Matrix:
    out: Matrix = {}
    for (q, m), (cost, audit) in one.items():
        for r in range(4):
            if (m, r) in two:
                found = cost + two[m, r][0], audit + two[m, r][1]
                if (q, r) not in out or found < out[q, r]:
                    out[q, r] = found
    return out


def solve(codes: str) -> tuple[int, str]:
    """Cost and audit of a conversation."""
    if len(codes) <= WHOLE:
        return cheapest(codes, START, None)
    ends = matrix(codes).items()
    return min((cost + INSERT * len(TRAIL[r]), audit + TRAIL[r]) for (q, r), (cost, audit) in ends if q == START)


def edited(audit: str, roles: list[str], texts: list[str], state: int = START) -> Iterator[tuple[str, str]]:
    """The turns that an audit leaves, from ``state`` on."""
    at = 0
    for edit in audit:
        if edit == "I":
            state = GIVEN[state]
            yield ROLES[state - ASKED], ""
            continue
        role, text = roles[at], texts[at]
        at += 1
        if edit == "K":
            state = NEXT[state, role[:1]]
            yield role, text
        elif edit == "R":
            state = GIVEN[state]
            yield ROLES[state - ASKED], text


def is_blank(text: str) -> bool:
    return not text.strip(SPACES)


def is_cut(text: str) -> bool:
    return text.rstrip(SPACES)[-1:] not in tuple(ENDS)


def faults_of(roles: list[str], texts: list[str], repeated: list[bool]) -> tuple[str, int, int, int, int]:
    """Codes of the rows, and numbers of blank, duplicate, truncated rows and of illegal neighbours."""
    codes, blank, duplicate, truncated = [], 0, 0, 0
    for role, text, again in zip(roles, texts, repeated):
        empty = is_blank(text)
        again = again and not empty
        cut = not empty and not again and is_cut(text)
        blank, duplicate, truncated = blank + empty, duplicate + again, truncated + cut
        codes.append(code(role[:1], empty, again, cut))
    pairs = (a[:1] + b[:1] for a, b in zip(roles, roles[1:]))
    return "".join(codes), blank, duplicate, truncated, sum(p not in ("su", "ua", "au") for p in pairs)


def digest_of(turns: Iterator[tuple[str, str]]) -> str:
    hashed, first = hashlib.sha256(), True
    for role, text in turns:
        hashed.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
        first = False
    return hashed.hexdigest()


def short_row(conv: Any, turns: list, roles: list[str], texts: list[str]) -> tuple:
    seen: set[tuple[str, str]] = set()
    repeated = []
    for pair in zip(roles, texts):
        repeated.append(pair in seen)
        seen.add(pair)
    codes, *counts = faults_of(roles, texts, repeated)
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit = solve(codes)
    return conv, gaps, *counts, cost, audit, digest_of(edited(audit, roles, texts))


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, list[list]]]:
    """Runs of rows with one value in the first column; the other columns as lists."""
    now, held = None, None
    for part in slices(batches):
        for conv, *values in zip(*(c.to_pylist() for c in part.columns)):
            if held is None or conv != now:
                if held is not None:
                    yield now, held
                now, held = conv, [[] for _ in values]
            for column, value in zip(held, values):
                column.append(value)
    if held is not None:
        yield now, held


def many(rows: list[tuple], columns: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], columns)


def in_batches(rows: Iterator[tuple], columns: list[str], types: list[pa.DataType], size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield many(held, columns, types)
            held = []
    if held:
        yield many(held, columns, types)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``; a row a conversation.

    Rows are taken by turn, null turns first; rows of one turn by role and text. A null role or text is one space; a null
    ``conv`` is a conversation of its own. Repeated rows are duplicates. Other columns are left out, whatever their names. An
    empty table has no conversations.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(c)
    flat = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    sizes = flat.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    long = stored(sizes.where((F.col("n") > LONG) | (F.col("chars") > LONG_CHARS)).select("conv"), "long")
    kind = dict(flat.dtypes)["conv"]
    schema = f"conv {kind}, " + ", ".join(f"{c} long" for c in FACTS) + ", audit string, repaired_sha256 string"
    some = not long.isEmpty()
    rest = flat.join(long.withColumnRenamed("conv", "which"), F.col("conv").eqNullSafe(F.col("which")), "left_anti") if some else flat

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, type_ = typed(batches)
        solved = (short_row(c, *columns) for c, columns in grouped(batches))
        types = [type_, *[pa.int64()] * len(FACTS), pa.string(), pa.string()]
        yield from in_batches(solved, ["conv", *FACTS, "audit", "repaired_sha256"], types)

    out = rest.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text").mapInArrow(short, schema)
    if some:
        out = out.union(long_conversations(flat.join(long.withColumnRenamed("conv", "which"), F.col("conv").eqNullSafe(F.col("which")), "left_semi"), kind, schema))
    return out.withColumnRenamed("conv", conv)


def typed(batches: Iterator[pa.RecordBatch]) -> tuple[Iterator[pa.RecordBatch], pa.DataType]:
    """The batches, and the type of their first column."""
    first = next(batches, None)
    if first is None:
        return iter(()), pa.null()

    def all_() -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    return all_(), first.schema.field(0).type


STRETCH = "part int, seq int, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, places array<int>"


def long_conversations(flat: DataFrame, kind: str, schema: str) -> DataFrame:
    """``repair`` for conversations that no single task holds."""
    mark = F.sha2(F.to_json(F.struct("role", "text")), 256)
    when = F.struct(F.col("turn").isNotNull().alias("late"), F.col("turn").alias("turn"))
    rows = flat.withColumn("mark", mark)
    first = rows.groupBy("conv", "mark").agg(F.min(when).alias("first"))
    first = first.select(F.col("conv").alias("of"), F.col("mark").alias("told"), "first")
    rows = rows.join(first, F.col("conv").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("told"))).withColumn("later", when > F.col("first"))
    # Ranges look at the head of a text, so that no long text is a border; rows with one head stay together.
    order = ["conv", F.asc_nulls_first("turn"), "role"]
    rows = rows.select("conv", "turn", "mark", "role", "text", "later").repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, type_ = typed(batches)
        part = TaskContext.get().partitionId()
        names = ["conv", "part", "seq", "blank", "duplicate", "truncated", "illegal", "first", "last", "costs", "places", "audits", "roles", "texts"]
        longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
        types = [type_, pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string(), longs, pa.list_(pa.int32()), strings, strings, strings]

        def made() -> Iterator[tuple]:
            for seq, (c, roles, texts, repeated) in enumerate(stretches(batches)):
                codes, *counts = faults_of(roles, texts, repeated)
                found = matrix(codes)
                costs, audits = zip(*(found.get((q, r), (BAD, "")) for q in range(4) for r in range(4)))
                # Of the ways out of one state, the audits' order decides ties between whole paths.
                places = [sorted(audits[4 * q : 4 * q + 4]).index(audits[4 * q + r]) for q in range(4) for r in range(4)]
                yield c, part, seq, *counts, roles[0][:1], roles[-1][:1], list(costs), places, list(audits), roles, texts

        yield from in_batches(made(), names, types, 1)

    whole = stored(rows.mapInArrow(search, f"conv {kind}, {STRETCH}, audits array<string>, roles array<string>, texts array<string>"), "stretches")
    turns = flat.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    gaps = gaps.select(F.col("conv").alias("of"), "gaps")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    told = stored(whole.groupBy("conv").agg(*sums).join(gaps, F.col("conv").eqNullSafe(F.col("of"))).drop("of"), "told")
    narrow = whole.select("conv", "part", "seq", "first", "last", "costs", "places")
    ways = stored(narrow.groupBy("conv").applyInPandas(chosen, f"conv {kind}, part int, seq int, enter int, leave int, trail string, cost long, seams long"), "ways")
    chosen_audit = F.element_at("audits", (4 * F.col("enter") + F.col("leave") + 1).cast("int"))
    ready = whole.select("part", "seq", "roles", "texts", "audits").join(ways, ["part", "seq"])
    ready = ready.select("conv", "part", "seq", "enter", F.concat(chosen_audit, "trail").alias("audit"), "roles", "texts")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, type_ = typed(batches)

        def made() -> Iterator[tuple]:
            now, hashed, audits, opened = None, None, [], False
            for part in batches:
                # One stretch at a time is Python objects.
                for i in range(part.num_rows):
                    c, _, _, enter, audit, roles, texts = (col[i].as_py() for col in part.columns)
                    if hashed is not None and c != now:
                        yield now, "".join(audits), hashed.hexdigest()
                        hashed = None
                    if hashed is None:
                        now, hashed, audits, opened = c, hashlib.sha256(), [], False
                    audits.append(audit)
                    for role, text in edited(audit, roles, texts, enter):
                        hashed.update(("\n" if opened else "").encode() + f"{role}:{text}".encode())
                        opened = True
            if hashed is not None:
                yield now, "".join(audits), hashed.hexdigest()

        yield from in_batches(made(), ["conv", "audit", "repaired_sha256"], [type_, pa.string(), pa.string()])

    texts = ready.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(write, f"conv {kind}, audit string, repaired_sha256 string")
    texts = texts.select(F.col("conv").alias("of"), "audit", "repaired_sha256")
    costs = ways.groupBy("conv").agg(F.max("cost").alias("cost"), F.sum("seams").alias("seams")).withColumnRenamed("conv", "whose")
    out = told.join(texts, F.col("conv").eqNullSafe(F.col("of"))).join(costs, F.col("conv").eqNullSafe(F.col("whose")))
    out = out.withColumn("illegal", F.col("illegal") + F.col("seams"))
    return out.select("conv", *[F.col(c).cast("long") for c in FACTS], "audit", "repaired_sha256")


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, list[str], list[str], list[bool]]]:
    """Runs of a conversation's rows, of ``LONG`` rows and ``LONG_CHARS`` characters at most (one row may have more)."""
    held: tuple | None = None
    now = before = None
    chars = 0
    for part in slices(batches):
        for c, turn, mark, role, text, later in zip(*(col.to_pylist() for col in part.columns)):
            if held is not None and (c != now or len(held[0]) >= LONG or chars + len(text) > LONG_CHARS):
                yield now, *held
                held = None
            if held is None:
                held, chars = ([], [], []), 0
            # Copies of one turn stand side by side, over the end of a stretch too.
            again = later or (c, turn, mark) == before
            now, before, chars = c, (c, turn, mark), chars + len(text)
            for column, value in zip(held, (role, text, again)):
                column.append(value)
    if held is not None:
        yield now, *held


def chosen(rows: pd.DataFrame) -> pd.DataFrame:
    """How the best path of one conversation enters and leaves each of its stretches, from their costs alone."""
    rows = rows.sort_values(["part", "seq"])
    costs, places = rows["costs"].tolist(), rows["places"].tolist()
    after = [INSERT * len(TRAIL[r]) for r in range(4)]
    ways = []
    for cost, place in zip(reversed(costs), reversed(places)):
        best = [min((cost[4 * q + r] + after[r], place[4 * q + r], r) for r in range(4)) for q in range(4)]
        after = [b[0] for b in best]
        ways.append([b[2] for b in best])
    state, enter, leave = START, [], []
    for way in reversed(ways):
        enter.append(state)
        state = way[state]
        leave.append(state)
    seams = [0] + [int(a + b not in ("su", "ua", "au")) for a, b in zip(rows["last"].tolist(), rows["first"].tolist()[1:])]
    trail = [""] * (len(rows) - 1) + [TRAIL[state]]
    told = {"part": rows["part"], "seq": rows["seq"], "enter": enter, "leave": leave, "trail": trail, "cost": after[START], "seams": seams}
    return pd.DataFrame({"conv": rows["conv"], **told})


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with one in four damaged, as a hash of conversation and turn says: dropped, emptied, without ends of sentences,
    repeated, or given to the user. Nulls are one space (a null turn or conversation stays null)."""
    told = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", told(conv), told(turn)).cast("binary")) % 20
    out = rows.select(F.col(f"`{conv}`").alias(conv), F.col(f"`{turn}`").alias(turn), told(role).alias(role), told(text).alias(text), fate.alias("_fate"))
    out = out.where("_fate != 0").withColumn(text, F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace(F.col(f"`{text}`"), "[.!?]", "")).otherwise(F.col(f"`{text}`")))
    out = out.withColumn(role, F.when(F.col("_fate") == 4, "user").otherwise(F.col(f"`{role}`")))
    times = F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_time")
    return out.select(conv, turn, role, text, times).drop("_time")


def for_all(found: DataFrame, conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A row for every conversation of ``conversations``; one that has no rows in ``found`` has nothing wrong and nothing left."""
    ids = conversations.select(F.col(f"`{conv}`").alias(conv)).distinct()
    all_ = ids.join(found.withColumnRenamed(conv, "of"), F.col(conv).eqNullSafe(F.col("of")), "left").drop("of")
    facts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in FACTS]
    nothing = hashlib.sha256().hexdigest()
    return all_.select(conv, *facts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
