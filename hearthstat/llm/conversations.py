"""Repair of conversation structure by the cheapest edits, in linear space.

A conversation is sound if its role initials read ``(s?(ua)+)?``.  Reading them takes four
states: nothing yet, after system, after user, after assistant.  Each row is kept, given another
role, or deleted, and rows may be inserted before it; so a row is a table of 4 x 4 costs, and so
is a run of rows.  Which table depends on the row's initial and fault only, and from one
vector of costs to the next there are few different steps, so every step is computed once and
then looked up.

Hirschberg's division: forward costs of the first half and backward costs of the second meet
in the middle; the best crossing is the state of least sum, and among equals the one whose
edits so far are ASCII-least.  Forward vectors carry, beside costs, the order of the four
states' least edit strings (none is the beginning of another, since each ends with the same
row's letter), so that choice needs no string.  Both halves then have known ends and are
divided again.  Space is one letter for a row.

On Spark, rows are sorted by range partitions, so a conversation of any length spreads over
tasks, and cut into blocks of at most ``BLOCK_ROWS`` rows.  A block sends its 4 x 4 table; the
blocks of a conversation are divided just like rows, at a few numbers each; then every block is
solved between the two states it got.  Only the pieces of conversations of more than one block
are put together again, as a stream in their order, for the digest of the whole.

Defined results: NULL role or text is one space; rows of one turn stand by role, then by a hash
of the text; equal rows are copies of which the first may stay; NULL turns come first; a NULL
id is an id; initials other than s, u, a are never kept; a conversation without rows after
damage has zeros and the digest of the empty text; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .staging import staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs; the last is for a kept truncated row
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
FAR = 1 << 60
_NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # what a new role must be
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_ROLE = {"u": "user", "a": "assistant"}
_TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # insertions that end a conversation

Vector = tuple  # four costs, less the least of them, and four places in the order of edit strings
Table = tuple  # [from][to] of (cost, order among the row's four, edits or None)


@functools.cache
def row_table(kind: str) -> Table:
    """Costs and edits of one row: its initial, or ``-``, and its fault.

    Blank and duplicate rows (``b``, ``d``) must go; truncated ones (``!``) are dear to keep.
    """
    initial, fault = kind[0], kind[1:]
    dear = TRUNCATED if fault == "!" else 0
    table = []
    for begin in STATES:
        ways: dict[int, tuple] = {}
        state, cost, letters = begin, 0, ""
        for _ in range(3):  # no insertion, one, or two; three only come back to a state
            steps = [(state, cost + DELETE, letters + "D")]
            if fault not in ("b", "d"):
                if initial == _NEXT[state] or initial == "s" and state == START:
                    steps.append((_AFTER[initial], cost + KEEP + dear, letters + "K"))
                steps.append((_AFTER[_NEXT[state]], cost + REROLE + dear, letters + "R"))
            for to, c, edits in steps:
                ways[to] = min(ways.get(to, (FAR, "")), (c, edits))
            state, cost, letters = _AFTER[_NEXT[state]], cost + INSERT, letters + "I"
        order = sorted(ways, key=lambda to: ways[to][1])
        table.append(tuple((*ways[to][:1], order.index(to), ways[to][1]) if to in ways else (FAR, 0, None) for to in STATES))
    return tuple(table)


def _ranked(found: list[tuple]) -> Vector:
    """Costs less the least, and the order of (order so far, order of the step)."""
    least = min(c for c, _ in found)
    keys = sorted({key for c, key in found if c < FAR})
    return tuple((c - least, keys.index(key)) if c < FAR else (FAR, 0) for c, key in found)


@functools.lru_cache(1 << 16)
def forward(vector: Vector, table: Table) -> Vector:
    """From the costs before a row to those after it."""
    found = []
    for to in STATES:
        ways = [(vector[s][0] + table[s][to][0], (vector[s][1], table[s][to][1])) for s in STATES if vector[s][0] < FAR and table[s][to][0] < FAR]
        found.append(min(ways, default=(FAR, ())))
    return _ranked(found)


@functools.lru_cache(1 << 16)
def backward(vector: tuple, table: Table) -> tuple:
    """From the costs to the end after a row to those before it."""
    found = [min(min(table[s][to][0] + vector[to], FAR) for to in STATES) for s in STATES]
    least = min(found)
    return tuple(c - least if c < FAR else FAR for c in found)


def only(state: int) -> Vector:
    return tuple((0 if s == state else FAR, 0) for s in STATES)


def crossings(tables: Sequence[Table], begin: int, end: int) -> list[int]:
    """The states between rows, and both ends, of the cheapest way, ASCII-least among equals."""
    states = [begin] * (len(tables) + 1)
    states[-1] = end
    todo = [(0, len(tables))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        first = only(states[low])
        for table in tables[low:middle]:
            first = forward(first, table)
        second = tuple(0 if s == states[high] else FAR for s in STATES)
        for i in range(high - 1, middle - 1, -1):
            second = backward(second, tables[i])
        states[middle] = min((first[s][0] + second[s], first[s][1], s) for s in STATES if first[s][0] < FAR and second[s] < FAR)[2]
        todo += [(low, middle), (middle, high)]
    return states


def end_state(tables: Sequence[Table]) -> int:
    """The state after the last row from which ending is cheapest in all."""
    vector = only(START)
    for table in tables:
        vector = forward(vector, table)
    return min((vector[s][0] + INSERT * _TAIL[s], vector[s][1], s) for s in STATES if vector[s][0] < FAR)[2]


def run_table(tables: Sequence[Table]) -> Table:
    """Costs and orders of a whole run of rows."""
    out = []
    for begin in STATES:
        vector, cost = only(begin), 0
        for table in tables:
            after = forward(vector, table)
            cost += min(vector[s][0] + table[s][to][0] for s in STATES for to in STATES)
            vector = after
        out.append(tuple((c + cost, order, None) if c < FAR else (FAR, 0, None) for c, order in vector))
    return tuple(out)


def edits_of(tables: Sequence[Table], begin: int, end: int) -> list[str]:
    """The letters of each row: insertions before it, then its own edit."""
    states = crossings(tables, begin, end)
    return [table[s][to][2] for table, s, to in zip(tables, states[:-1], states[1:])]


def apply_edits(edits: Sequence[str], roles: Sequence[str], texts: Sequence[str], begin: int) -> tuple[list[str], int]:
    """The repaired ``role:text`` lines, and the state they end in."""
    lines, state = [], begin
    for letters, role, text in zip(edits, roles, texts):
        for letter in letters:
            if letter == "D":
                continue
            new = role[:1] if letter == "K" else _NEXT[state]
            name = role if letter == "K" else _ROLE[new]
            lines.append(f"{name}:{'' if letter == 'I' else text}")
            state = _AFTER[new]
    return lines, state


def closing(state: int) -> list[str]:
    """Inserted lines that end a conversation from a state."""
    lines = []
    for _ in range(_TAIL[state]):
        lines.append(f"{_ROLE[_NEXT[state]]}:")
        state = _AFTER[_NEXT[state]]
    return lines


# On Spark -----------------------------------------------------------------------------


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text, n``: rows after damage by a checksum of id and turn, with their number of copies."""
    space = F.lit(" ")
    conv, turn = F.col(conv_col), F.col(turn_col)
    key = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col(role_col), space), F.coalesce(F.col(text_col), space)
    return conversations.select(
        conv.alias("conv"),
        turn.alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    ).filter("n > 0")


def with_faults(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, and ``first``, ``blank``, ``cut``.

    ``first``: no earlier row of the conversation has this role and text.  Copies and first
    turns are merged before the shuffle, so neither a common text nor one that fills a
    conversation meets in a task; the join back is split where it is skewed.
    """
    keys = ["conv", "role", "text"]
    merged = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    firsts = rows.groupBy(*keys).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least"))
    other = firsts.select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("least.turn").alias("first_turn"))
    same = merged["conv"].eqNullSafe(other["_conv"]) & (merged["role"] == other["_role"]) & (merged["text"] == other["_text"])
    joined = merged.join(other, same)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return joined.select(
        "conv", "turn", "role", "text", "n",
        F.col("turn").eqNullSafe(F.col("first_turn")).alias("first"),
        (last == "").alias("blank"),
        (~last.isin(".", "!", "?") & (last != "")).alias("cut"),
    )


_BLOCK = """part int, number int, first string, last string, costs array<long>, orders array<int>,
    kinds string, copies array<long>, roles array<string>, texts array<string>,
    low {turn}, high {turn}, turns long, illegal long, blank long, duplicate long, truncated long"""
_COUNTS = ("illegal", "blank", "duplicate", "truncated")
_STATE = "part int, number int, place long, blocks long, begin int, end int"
_PIECE = "place long, blocks long, cost long, audit string, n_lines long, repaired string, digest string, first string, last string"


def blocks(rows: DataFrame) -> DataFrame:
    """Rows in order as blocks of one conversation each, with the block's table of costs."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("blank"), "b").when(~F.col("first"), "d").when(F.col("cut"), "!").otherwise(" ")
    kind = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), fault)
    turn = rows.schema["turn"].dataType.simpleString()
    schema = T.StructType([rows.schema["conv"], *T.StructType.fromDDL(_BLOCK.format(turn=turn)).fields])

    def cut(batches):
        part, number, held, conv, size = TaskContext.get().partitionId(), 0, [], None, 0
        for batch in batches:
            for name, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (name != conv or len(held) >= BLOCK_ROWS or size > BLOCK_BYTES):
                    yield {"conv": conv, "part": part, "number": number, **_block(held)}
                    number, held, size = number + 1, [], 0
                conv = name
                held.append(row)
                size += len(row[-1])
        if held:
            yield {"conv": conv, "part": part, "number": number, **_block(held)}

    return ordered.select("conv", "turn", kind.alias("kind"), "n", "role", "text").mapInArrow(_batched(cut, schema), schema)


def _block(rows: list) -> dict:
    turns, kinds, copies, roles, texts = map(list, zip(*rows))
    initials, faults = [k[0] for k in kinds], [k[1] for k in kinds]
    table = run_table(list(_tables(kinds, copies)))
    known = [t for t in turns if t is not None]
    return {
        "first": initials[0], "last": initials[-1], "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)),
        "costs": [c for line in table for c, _, _ in line], "orders": [o for line in table for _, o, _ in line],
        "kinds": "".join(kinds), "copies": copies, "roles": roles, "texts": texts,
        "illegal": sum(map(_illegal, initials[:-1], initials[1:])) + sum(copies) - len(copies),
        "blank": sum(n for n, f in zip(copies, faults) if f == "b"),
        "duplicate": sum(n if f == "d" else n - 1 for n, f in zip(copies, faults) if f != "b"),
        "truncated": faults.count("!"),
    }


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _tables(kinds: Sequence[str], copies: Sequence[int]) -> Iterator[Table]:
    """A table for every row; of equal rows all but the first must go."""
    for kind, n in zip(kinds, copies):
        yield row_table(kind)
        for _ in range(n - 1):
            yield row_table(kind[0] + ("b" if kind[1] == "b" else "d"))


def _batched(rows_of, schema: T.StructType, at_once: int = 500, most: int = 4 << 20):
    """A function on batches from one that yields rows as dicts."""
    arrow = to_arrow_schema(schema)
    large = [f.name for f in schema.fields if f.name in ("texts", "repaired", "audit")]

    def run(batches):
        held, size = [], 0
        for row in rows_of(batches):
            held.append(row)
            size += sum(len(row[c] or "") if isinstance(row[c], str) else sum(map(len, row[c] or ())) for c in large)
            if len(held) >= at_once or size > most:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return run


def _by_conversation(batches) -> Iterator[tuple]:
    """Runs of rows, as dicts, that have the same ``conv``."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return itertools.groupby(rows, key=lambda r: r["conv"])


def block_states(found: DataFrame) -> DataFrame:
    """The states between which each block is solved: blocks are divided like rows.

    A task sees 32 numbers for each block of the conversations it got, and no text.
    """
    schema = T.StructType.fromDDL(_STATE)

    def divide(batches):
        for _, group in _by_conversation(batches):
            rows = list(group)
            tables = [tuple(tuple((r["costs"][4 * s + to], r["orders"][4 * s + to], None) for to in STATES) for s in STATES) for r in rows]
            states = crossings(tables, START, end_state(tables))
            for place, r in enumerate(rows):
                yield {"part": r["part"], "number": r["number"], "place": place, "blocks": len(rows), "begin": states[place], "end": states[place + 1]}

    narrow = found.select("conv", "part", "number", "costs", "orders")
    return narrow.repartition("conv").sortWithinPartitions("conv", "part", "number").mapInArrow(_batched(divide, schema), schema)


def repaired(found: DataFrame, states: DataFrame) -> DataFrame:
    """Every block solved between its states; its text only where a conversation has more blocks."""
    joined = found.join(states, ["part", "number"])
    turn = found.schema["low"].dataType.simpleString()
    fields = f"low {turn}, high {turn}, turns long, " + ", ".join(f"{c} long" for c in _COUNTS)
    schema = T.StructType([found.schema["conv"], *T.StructType.fromDDL(f"{_PIECE}, {fields}").fields])

    def solve(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield _solved(batch.slice(i, 1).to_pylist()[0])

    wanted = ["conv", "place", "blocks", "begin", "end", "kinds", "copies", "costs", "roles", "texts", "first", "last", "low", "high", "turns", *_COUNTS]
    return joined.select(*wanted).mapInArrow(_batched(solve, schema), schema)


def _solved(r: dict) -> dict:
    kinds = [r["kinds"][i : i + 2] for i in range(0, len(r["kinds"]), 2)]
    edits = edits_of(list(_tables(kinds, r["copies"])), r["begin"], r["end"])
    every = lambda values: itertools.chain.from_iterable(map(itertools.repeat, values, r["copies"]))
    lines, state = apply_edits(edits, every(r["roles"]), every(r["texts"]), r["begin"])
    cost = r["costs"][4 * r["begin"] + r["end"]]
    if r["place"] == r["blocks"] - 1:
        added = closing(state)
        lines += added
        edits.append("I" * len(added))
        cost += INSERT * len(added)
    text, whole = "\n".join(lines), r["blocks"] == 1
    kept = {c: r[c] for c in ("conv", "place", "blocks", "first", "last", "low", "high", "turns", *_COUNTS)}
    return {
        **kept, "cost": cost, "audit": "".join(edits), "n_lines": len(lines),
        "repaired": None if whole else text, "digest": hashlib.sha256(text.encode()).hexdigest() if whole else None,
    }


_SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def together(pieces: DataFrame) -> DataFrame:
    """One row for each conversation from its pieces, read as a stream in their order."""
    schema = T.StructType([pieces.schema["conv"], *(T.StructField(c, T.LongType()) for c in _SUMS), T.StructField("audit", T.StringType()), T.StructField("digest", T.StringType())])

    def join(batches):
        for conv, group in _by_conversation(batches):
            sums, audit, digest, last = dict.fromkeys(_SUMS, 0), [], hashlib.sha256(), None
            low = high = None
            lines, turns = 0, 0
            for r in group:
                for c in _SUMS[1:]:
                    sums[c] += r[c]
                sums["illegal"] += last is not None and _illegal(last, r["first"])
                last = r["last"]
                if r["low"] is not None:
                    turns += r["turns"] - (r["low"] == high)
                    low, high = r["low"] if low is None else low, r["high"]
                audit.append(r["audit"])
                if r["n_lines"]:
                    digest.update(("\n" * (lines > 0) + r["repaired"]).encode())
                    lines += r["n_lines"]
            sums["gaps"] = 0 if low is None else int(high - low + 1 - turns)
            yield {"conv": conv, **sums, "audit": "".join(audit), "digest": digest.hexdigest()}

    return pieces.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(_batched(join, schema), schema)


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damage the rows and repair what is left: one row for every id of the table.

    Columns: the id, ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    """
    rows = with_faults(damaged(conversations, conv_col, turn_col, role_col, text_col))
    found = staged(blocks(rows), "conversation_blocks")
    pieces = staged(repaired(found, block_states(found)), "conversation_pieces")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    alone = pieces.filter("blocks = 1").select("conv", gaps, *_SUMS[1:], "audit", "digest")
    whole = alone.unionByName(together(pieces.filter("blocks > 1")))
    ids = conversations.select(F.col(conv_col).alias("_id")).distinct()
    return ids.join(whole, F.col("_id").eqNullSafe(F.col("conv")), "left").select(
        F.col("_id").alias(conv_col),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _SUMS),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
