"""Repair of conversations by cheapest edits, with Four-Russians block tables.

A conversation's turns, in order of turn (NULL first; rows of one turn by role, then by
the SHA-256 of their text), become symbols: initial of the role, and whether the
row must go (blank, or a role and text seen before) or ends in the middle of a sentence.
Edits keep, rerole, delete or insert until the roles read ``(s?(ua)+)?``.  Being so far through
that pattern is one of four states, so the costs of finishing are a vector of four
numbers, and less their smallest there are only a few such vectors (``Tables``).

1. *Tables.*  For every vector and every block of ``BLOCK`` symbols: the vector in front of the block and what is added,
   and for every state in front of it the state behind.  They follow from the rules and are made in each worker.
2. *Segments.*  Rows are sorted by ranges and cut into segments of one conversation and at
   most ``SEGMENT`` rows.  A segment's own transition, for every vector that may
   follow it, comes from lookups by block, whatever the other segments are.
3. *Chain.*  Per conversation, a row per segment passes by: from the last to the first, for the vector
   behind each, then from the first, for the state in front.
4. *Tracing.*  With both known, segments are traced each by itself: blocks are expanded backward to the
   vectors behind each symbol, and the least letter that keeps to the cheapest cost is taken.
   As no letter's choice is left open, ties give the ASCII-least edits.

A conversation may hold a third of all rows: its sorting, faults, transitions and traces are
spread.  Only its chain (a row in ``SEGMENT``), and the reading of its repaired lines in order, which a SHA-256
needs, are one task's; both pass rows by and hold none but the edits' letters.  Rows that repeat are told apart by a
row number, so that they part too.

NULL role or text is one space, hence a blank row; NULL ids are one conversation; NULL turns count in no gap, and a
gap beyond a BIGINT is NULL.  Texts of any length are read whole.  Other columns, whatever their names, are not
looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfproof.llm.common import stored

BLOCK, SEGMENT = 4, 4096
BLANKS = " \t\n\x0b\x0c\r"

# Fixed values of the edits: costs, and the states of the role pattern.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: The state behind a turn written for a user or assistant, by the state in front.
WRITTEN = (USER, USER, ASSISTANT, USER)
#: The state behind a kept turn, by its initial and the state in front; other turns cannot be kept.
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
INITIALS = "sua"
ADJACENT = {"su", "ua", "au"}

#: Symbols: s, u, a or another initial; the same cut off; to be deleted; and nothing, to fill a block.
GONE, NOTHING, SYMBOLS = 8, 9, 10


class Tables:
    """Normalised cost vectors and their transitions by symbol and by block of symbols."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block = block
        ends = self._relaxed([0, None, None, 0])
        self.vectors, index, todo = [ends], {ends: 0}, [0]
        nexts: list[list[int]] = []
        adds: list[list[int]] = []
        while todo:
            v = todo.pop(0)
            row_next, row_add = [], []
            for symbol in range(SYMBOLS):
                costs = self.before(self.vectors[v], symbol)
                least = min(costs)
                new = tuple(c - least for c in costs)
                if new not in index:
                    index[new] = len(self.vectors)
                    self.vectors.append(new)
                    todo.append(index[new])
                row_next.append(index[new])
                row_add.append(least)
            nexts.append(row_next)
            adds.append(row_add)
        self.next1, self.add1 = np.array(nexts, dtype=np.int16), np.array(adds, dtype=np.int32)
        n = len(self.vectors)
        self.letters1 = [[[self._trace(v, s, q) for q in range(4)] for s in range(SYMBOLS)] for v in range(n)]
        to1 = np.array([[[q for _, q in row] for row in part] for part in self.letters1], dtype=np.int8)
        code = np.arange(SYMBOLS ** block)
        self.symbols = np.stack([code // SYMBOLS ** (block - 1 - k) % SYMBOLS for k in range(block)])
        behind = np.repeat(np.arange(n, dtype=np.int16)[:, None], len(code), axis=1)
        self.add = np.zeros(behind.shape, dtype=np.int32)
        each = []
        for k in reversed(range(block)):
            each.insert(0, behind)
            self.add += self.add1[behind, self.symbols[k]]
            behind = self.next1[behind, self.symbols[k]]
        self.next = behind
        self.to = np.repeat(np.arange(4, dtype=np.int8)[None, None, :], n, axis=0).repeat(len(code), axis=1)
        for k in range(block):
            self.to = to1[each[k][:, :, None], self.symbols[k][None, :, None], self.to]
        self.expanded: dict[tuple[int, int, int], list[str]] = {}

    @staticmethod
    def _relaxed(costs: list[int | None]) -> tuple[int, ...]:
        """Costs by state when turns may be inserted in front too."""
        far = 1 << 20
        now = [far if c is None else c for c in costs]
        for _ in range(4):
            now = [min(c, INSERT + now[WRITTEN[q]]) for q, c in enumerate(now)]
        return tuple(now)

    @staticmethod
    def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
        """Letter, cost and next state of what may be done with a turn, in order of letters."""
        if symbol == NOTHING:
            return [("", 0, state)]
        found = [("D", DELETE, state)]
        if symbol != GONE:
            late = CUT_OFF if symbol >= 4 else 0
            behind = KEPT.get((INITIALS[symbol % 4:symbol % 4 + 1], state))
            if behind is not None:
                found.append(("K", late, behind))
            found.append(("R", REROLE + late, WRITTEN[state]))
        return found

    def before(self, behind: tuple[int, ...], symbol: int) -> tuple[int, ...]:
        """Costs in front of a symbol, by those behind it."""
        if symbol == NOTHING:
            return behind
        return self._relaxed([min(cost + behind[to] for _, cost, to in self.edits(symbol, q)) for q in range(4)])

    def _trace(self, v: int, symbol: int, state: int) -> tuple[str, int]:
        """Least letters of the cheapest edits through a symbol, and the state behind it."""
        behind = self.vectors[v]
        front = self.before(behind, symbol)
        letters = ""
        while True:
            ways = self.edits(symbol, state)
            if symbol != NOTHING:
                ways = sorted([*ways, ("I", INSERT, -1)])
            for letter, cost, to in ways:
                rest = front[WRITTEN[state]] if letter == "I" else behind[to]
                if cost + rest == front[state]:
                    break
            letters += letter
            if letter != "I":
                return letters, to
            state = WRITTEN[state]

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Blocks of symbols as numbers; the first is filled in front."""
        fill = -len(symbols) % self.block
        rows = np.concatenate([np.full(fill, NOTHING, dtype=np.int64), symbols]).reshape(-1, self.block)
        return rows @ (SYMBOLS ** np.arange(self.block - 1, -1, -1))

    def transition(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By vector behind: the vector in front, what is added, and the state behind by state in front."""
        codes = self.codes(symbols)
        at = np.arange(len(self.vectors), dtype=np.int16)
        added = np.zeros(len(at), dtype=np.int64)
        behind = []
        for code in codes[::-1]:
            behind.append(at)
            added += self.add[at, code]
            at = self.next[at, code]
        state = np.repeat(np.arange(4, dtype=np.int8)[None, :], len(self.vectors), axis=0)
        for code, v in zip(codes, reversed(behind), strict=True):
            state = self.to[v[:, None], code, state]
        return at, added, state

    def _expand(self, v: int, code: int, state: int) -> list[str]:
        key = (v, code, state)
        if key not in self.expanded:
            symbols, behind = self.symbols[:, code], []
            for s in symbols[::-1]:
                behind.append(v)
                v = int(self.next1[v, s])
            out = []
            for s, w in zip(symbols.tolist(), reversed(behind), strict=True):
                letters, state = self.letters1[w][s][state]
                if s != NOTHING:
                    out.append(letters)
            self.expanded[key] = out
        return self.expanded[key]

    def letters(self, symbols: np.ndarray, behind: int, state: int, last: bool) -> list[str]:
        """Edits in front of and at each turn; if these are the last turns, one more entry with those at the end."""
        codes, right = self.codes(symbols).tolist(), []
        for code in reversed(codes):
            right.append(behind)
            behind = int(self.next[behind, code])
        out: list[str] = []
        for code, v in zip(codes, reversed(right), strict=True):
            out += self._expand(v, code, state)
            state = int(self.to[v, code, state])
        if last:
            end = ""
            while state in (SYSTEM, USER):
                end, state = end + "I", WRITTEN[state]
            out.append(end)
        return out


@functools.cache
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """``turns`` with faults of five kinds, each in one row of twenty by the CRC-32 of ``conversation:turn``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    return turns.where(kind != 0).select(
        F.col(conv_col), F.col(turn_col), F.when(kind == 4, F.lit("user")).otherwise(space(role_col)).alias(role_col),
        text.alias(text_col), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_n")
    ).drop("_n")


def _segments(limit: int):
    """Segments of rows that come sorted by ``pos``, with their transitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tables()
        held: list[tuple] = []

        def row() -> tuple:
            symbols = np.array([h[2] for h in held], dtype=np.int64)
            to, added, state = table.transition(symbols)
            initials = [h[3] for h in held]
            illegal = sum(a + b not in ADJACENT for a, b in zip(initials, initials[1:]))
            return (held[0][0], held[0][1], symbols.astype(np.uint8).tobytes(), initials[0], initials[-1], illegal,
                    to.astype(np.int16).tobytes(), added.astype(np.int32).tobytes(), state.tobytes())

        for batch in batches:
            out = []
            for new in zip(*(batch.column(c).to_pylist() for c in ("conv", "pos", "symbol", "initial")), strict=True):
                if held and (new[0] != held[0][0] or new[1] >> 33 != held[0][1] >> 33 or len(held) == limit):
                    out.append(row())
                    held = []
                held.append(new)
            if out:
                yield _batch(out, SEGMENT_COLUMNS, batch.column("conv").type)
        if held:
            yield _batch([row()], SEGMENT_COLUMNS, batch.column("conv").type)

    return run


SEGMENT_COLUMNS = ("conv {kind}, pos long, symbols binary, first string, last string, illegal long, to binary, "
                   "added binary, state binary")
CHAIN_COLUMNS = SEGMENT_COLUMNS + ", behind int, final boolean"
PLAN_COLUMNS = "conv {kind}, pos long, symbols binary, behind int, start int, final boolean, cost long, illegal long"
EDIT_COLUMNS = "conv {kind}, pos long, start int, final boolean, edits array<string>"
LINE_COLUMNS = "conv {kind}, pos long, step int, edit string, role string, text string"
DIGEST_COLUMNS = "conv {kind}, audit string, repaired_sha256 string"
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
         "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], columns: str, conv_type: pa.DataType) -> pa.RecordBatch:
    names, types = zip(*(c.split() for c in columns.split(", ")), strict=True)
    arrays = [pa.array(list(col), conv_type if t == "{kind}" else ARROW[t])
              for col, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


_NEW = object()


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector behind each segment; segments come from the last of a conversation to its first."""
    conv, at = _NEW, 0
    for batch in batches:
        out = []
        for row in _rows(batch):
            final = conv is _NEW or row[0] != conv
            if final:
                conv, at = row[0], 0
            out.append((*row, at, final))
            at = int(np.frombuffer(row[6], dtype=np.int16)[at])
        yield _batch(out, CHAIN_COLUMNS, batch.column("conv").type)


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in front of each segment, its part of the cost and of the illegal neighbours; segments come in order."""
    table, conv, at, before = tables(), _NEW, START, ""
    for batch in batches:
        out = []
        for c, pos, symbols, first, last, illegal, to, added, state, behind, final in _rows(batch):
            cost = int(np.frombuffer(added, dtype=np.int32)[behind])
            if conv is _NEW or c != conv:
                conv, at = c, START
                cost += table.vectors[int(np.frombuffer(to, dtype=np.int16)[behind])][START]
            else:
                illegal += before + first not in ADJACENT
            out.append((c, pos, symbols, behind, at, final, cost, illegal))
            at, before = int(np.frombuffer(state, dtype=np.int8).reshape(-1, 4)[behind, at]), last
        yield _batch(out, PLAN_COLUMNS, batch.column("conv").type)


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, pos, symbols, behind, start, final in _rows(batch):
            symbols = np.frombuffer(symbols, dtype=np.uint8).astype(np.int64)
            out.append((conv, pos, start, final, tables().letters(symbols, behind, start, final)))
        yield _batch(out, EDIT_COLUMNS, batch.column("conv").type)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines after the edits; a segment's edits come just before its turns."""
    edits: Iterator[str] = iter(())
    left, state, last, step = 0, START, False, 0

    def lines(conv, pos: int, letters: str, role: str | None, text: str | None) -> Iterator[tuple]:
        nonlocal state, step
        for letter in letters:
            made: tuple[str | None, str | None] = (None, None)
            if letter == "K":
                state, made = KEPT[role[:1], state], (role, text)
            elif letter != "D":
                state = WRITTEN[state]
                made = ROLE_OF[state], text if letter == "R" else ""
            yield conv, pos, step, letter, *made
            step += 1

    for batch in batches:
        out: list[tuple] = []
        for conv, pos, kind, role, text, start, final, letters in _rows(batch):
            if kind == 0:
                edits, left, state, last = iter(letters), len(letters), start, final
                continue
            step = 0
            out += lines(conv, pos, next(edits), role, text)
            left -= 1
            if last and left == 1:  # what is inserted behind the last turn
                out += lines(conv, pos, next(edits), None, None)
        yield _batch(out, LINE_COLUMNS, batch.column("conv").type)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and digest of each conversation's lines, which come in order."""
    conv, audit, sha, first, kind = _NEW, [], hashlib.sha256(), True, None
    for batch in batches:
        kind, out = batch.column("conv").type, []
        for c, _, _, edit, role, text in _rows(batch):
            if conv is _NEW or c != conv:
                if conv is not _NEW:
                    out.append((conv, "".join(audit), sha.hexdigest()))
                conv, audit, sha, first = c, [], hashlib.sha256(), True
            audit.append(edit)
            if role is not None:
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if out:
            yield _batch(out, DIGEST_COLUMNS, kind)
    if conv is not _NEW:
        yield _batch([(conv, "".join(audit), sha.hexdigest())], DIGEST_COLUMNS, kind)


class Repair(NamedTuple):
    """``faults``: counts by conversation and turn.  ``plan``: cost and neighbours by segment.  ``lines``: edits and what they leave."""

    faults: DataFrame
    plan: DataFrame
    lines: DataFrame


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", segment: int = SEGMENT) -> Repair:
    """Faults, plan and repaired lines of conversations.

    ``lines`` has a row per edit, sorted by conversation (``conv``), place (``pos``) and ``step`` there: D without role and
    text, K, R and I with those of the repaired turn.
    """
    spark = turns.sparkSession
    kind = turns.schema[conv_col].dataType.simpleString()
    typed = lambda columns: columns.format(kind=kind)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    text = space(text_col)
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), space(role_col).alias("role"), text.alias("text"),
        F.unhex(F.sha2(text, 256)).alias("h"), F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1).alias("tail"),
        F.monotonically_increasing_id().alias("row"))
    order = ["conv", "turn", "role", "h", "row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = stored(rows.drop("row").withColumn("pos", F.monotonically_increasing_id()), "turns")
    firsts = rows.groupBy("conv", "role", "h").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    marked = rows.select("conv", "turn", "role", "tail", "pos").join(firsts, "pos", "left")
    blank = F.col("tail") == ""
    again = ~blank & F.col("new").isNull()
    cut = ~blank & ~again & ~F.col("tail").isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = F.when(blank | again, F.lit(GONE)).otherwise(role + F.when(cut, 4).otherwise(0))
    marked = stored(marked.select("conv", "turn", "pos", initial.alias("initial"), symbol.cast("int").alias("symbol"),
                                  blank.alias("blank"), again.alias("again"), cut.alias("cut")), "marked")
    faults = marked.groupBy("conv", "turn").agg(*[F.count_if(c).alias(c) for c in ("blank", "again", "cut")])
    cuts = marked.select("conv", "pos", "symbol", "initial").repartition(F.shiftright("pos", 33)).sortWithinPartitions("pos")
    segments = stored(cuts.mapInArrow(_segments(segment), typed(SEGMENT_COLUMNS)), "segments")
    behind = segments.repartition("conv").sortWithinPartitions("conv", F.desc("pos")).mapInArrow(_behind, typed(CHAIN_COLUMNS))
    plan = stored(behind.sortWithinPartitions("conv", "pos").mapInArrow(_start, typed(PLAN_COLUMNS)), "plan")
    edits = plan.select("conv", "pos", "symbols", "behind", "start", "final").mapInArrow(_traced, typed(EDIT_COLUMNS))
    both = edits.withColumn("kind", F.lit(0)).unionByName(
        rows.select("conv", "pos", F.lit(1).alias("kind"), "role", "text"), allowMissingColumns=True).select(
        "conv", "pos", "kind", "role", "text", "start", "final", "edits")
    lines = both.repartition("conv").sortWithinPartitions("conv", "pos", "kind").mapInArrow(_edited, typed(LINE_COLUMNS))
    return Repair(faults, plan, lines)


def summary(conversations: DataFrame, made: Repair, conv_col: str = "conv_id") -> DataFrame:
    """A row for every conversation of ``conversations``: gaps, faults, cost, edits and the digest of what is left."""
    kind = conversations.schema[conv_col].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    wide = "DECIMAL(38,0)"
    faults = made.faults.groupBy("conv").agg(
        F.expr(f"try_cast(max(turn) AS {wide}) - try_cast(min(turn) AS {wide}) + 1 - count(turn)").alias("gaps"),
        *[F.sum(c).alias(n) for c, n in (("blank", "blank"), ("again", "duplicate"), ("cut", "truncated"))])
    plan = made.plan.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    digests = made.lines.mapInArrow(_digested, DIGEST_COLUMNS.format(kind=kind))
    whole = conversations.select(F.col(conv_col).alias("conv")).distinct()
    for part in (faults, plan, digests):
        whole = whole.unionByName(part, allowMissingColumns=True)
    empty = F.sha2(F.lit(""), 256)
    found = whole.groupBy("conv").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), empty).alias("repaired_sha256"))
    return found.select(F.col("conv").alias(conv_col), *[F.expr(f"try_cast({c} AS BIGINT)").alias(c) for c in counts],
                        "audit", "repaired_sha256")
