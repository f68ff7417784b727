"""Conversation structure repair by Four-Russians block tables.

A repaired conversation's role initials read ``(s?(ua)+)?``.  The edits are Keep
(0), Rerole to user or assistant (2), Delete (3, required for blank and
duplicate rows) and Insert an empty user or assistant row (2); a truncated row
that is not deleted adds 1.  Of the cheapest edit sequences the one whose
initials come first in ASCII order is taken.

The pattern has four states.  The cost to go from each state past the rows
behind a place is a vector of four numbers; less its minimum it is one of a few
vectors, as from any state a few edits lead to any other that matters.  A row
is one of nine symbols (initial, fault).  So the tables give, for every
vector behind and every block of BLOCK symbols, the vector before and the cost
that it grew by: rows are taken a block at a time by lookup, from the last to
the first.  Only the vectors between blocks are kept; to trace, a block is
expanded backward from the vector behind it, and its rows then read forward,
taking at each the first letter that is still on a cheapest way.  All cheapest
sequences run through these vectors, so ties are settled exactly.

Rows are dealt to tasks by ranges of (conversation, turn, role and text) and read
in order, so no conversation is gathered.  One that lies within a task, and in
one segment of SEGMENT_ROWS rows, is repaired there.  Others are cut into
segments: copies are told by the first place of each text, a segment is looked
up for every vector behind it at once, the segments of a conversation are
joined from their small tables (one row for thousands of rows), and each is
then traced on its own.  Only the digest of a repaired text, which is one chain
of bytes, is a stream through one task, and the audit of a conversation one string.

Defined cases: null text and role are one space, also in the key of the damage
null ids and turns; a null conversation id is a conversation; rows of one turn
go by role, then the first 64 characters of the text, then a hash of it; an empty role has no initial; repeated rows are rows; a
table without rows gives none; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from staylens.llm.common import small_batches
from staylens.session import cut_lineage

BLOCK = 4
SEGMENT_ROWS = 4096
SEGMENT_BYTES = 1 << 22
_SPACE = " \t\n\x0b\x0c\r"
_STOPS = ".!?"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
ROLES = ["user", "assistant"]

# States: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = 4
_ON = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
_INITIALS = "sua"
SYMBOLS = 9  # 0: has to go; 1 + 4 * truncated + (s, u, a, other)
_NEVER = 1 << 20


def symbol(role: str, truncated: bool) -> int:
    return 1 + 4 * truncated + (_INITIALS.find(role[:1]) if role[:1] in ("s", "u", "a") else 3)


def _written(state: int) -> tuple[int, int]:
    """What an inserted or reroled row becomes in a state (index of ROLES), and the state after it."""
    role = int(state == AFTER_U)
    return role, _ON[ROLES[role][0]][state]


def _with_inserts(vector: list[int]) -> tuple[int, ...]:
    vector = list(vector)
    for _ in range(STATES):
        for state in range(STATES):
            vector[state] = min(vector[state], 2 + vector[_written(state)[1]])
    return tuple(vector)


def _edits(sym: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, state after) of the edits of one row, in ASCII order."""
    out = [("D", 3, state)]
    if sym:
        truncated, kind = divmod(sym - 1, 4)
        if kind < 3 and state in _ON[_INITIALS[kind]]:
            out.append(("K", truncated, _ON[_INITIALS[kind]][state]))
        out.append(("R", 2 + truncated, _written(state)[1]))
    return out


class Tables:
    """Transitions of the normalised cost vectors for every block of ``block`` symbols."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors = [_with_inserts([0, _NEVER, _NEVER, 0])]  # behind the last row
        known, before, grown = {self.vectors[0]: 0}, [], []
        for vector in self.vectors:  # grows while vectors are found
            before.append([])
            grown.append([])
            for sym in range(SYMBOLS):
                raw = _with_inserts([min(cost + vector[to] for _, cost, to in _edits(sym, state)) for state in range(STATES)])
                least = min(raw)
                found = tuple(x - least for x in raw)
                if found not in known:
                    known[found] = len(self.vectors)
                    self.vectors.append(found)
                before[-1].append(known[found])
                grown[-1].append(least)
        self.before, self.grown = before, grown
        one, one_grown = np.array(before), np.array(grown)
        table, cost = one, one_grown
        for _ in range(block - 1):  # one more symbol in front
            cost = (cost[:, :, None] + one_grown[table]).swapaxes(1, 2).reshape(len(one), -1)
            table = one[table].swapaxes(1, 2).reshape(len(one), -1)
        self.block_before, self.block_grown = table, cost
        self._before, self._grown = table.tolist(), cost.tolist()
        self.steps = [[[self._step(v, s, q) for q in range(STATES)] for s in range(SYMBOLS)] for v in range(len(one))]
        self.ends = [self._inserts(self.vectors[0], q, 0) for q in range(STATES)]

    def _inserts(self, vector: tuple[int, ...], state: int, target: int) -> tuple[str, int, tuple[int, ...]]:
        roles = []
        while vector[state] != target:
            role, state = _written(state)
            roles.append(role)
        return "I" * len(roles), state, tuple(roles)

    def _step(self, behind: int, sym: int, state: int) -> tuple[str, int, tuple[int, ...], int]:
        """Letters for a row, the state after it, the roles of rows inserted before it, and its own new role (-1: none, -2: row gone)."""
        after, now, grown = self.vectors[behind], self.vectors[self.before[behind][sym]], self.grown[behind][sym]
        letters, inserted = "", []
        while True:
            way = {letter: to for letter, cost, to in _edits(sym, state) if cost + after[to] == now[state] + grown}
            role, to = _written(state)
            if now[state] == 2 + now[to]:
                way["I"] = to
            letter = min(way)
            letters += letter
            if letter != "I":
                return letters, way[letter], tuple(inserted), {"D": -2, "K": -1, "R": role}[letter]
            inserted.append(role)
            state = to

    def _blocks(self, symbols: list[int]) -> tuple[int, list[int]]:
        """Rows in front of the first whole block, and the number of each block."""
        head, codes = len(symbols) % self.block, []
        for i in range(head, len(symbols), self.block):
            code = 0
            for sym in symbols[i : i + self.block]:
                code = code * SYMBOLS + sym
            codes.append(code)
        return head, codes

    def cost(self, symbols: list[int], behind: int = 0) -> tuple[list[int], int, int]:
        """Vectors behind the head and each block, the vector before all rows, and the cost it grew by."""
        head, codes = self._blocks(symbols)
        vectors, total = [behind], 0
        for code in reversed(codes):
            total += self._grown[behind][code]
            behind = self._before[behind][code]
            vectors.append(behind)
        for sym in reversed(symbols[:head]):
            total += self.grown[behind][sym]
            behind = self.before[behind][sym]
        return vectors[::-1], behind, total

    def trace(self, symbols: list[int], state: int, vectors: list[int]) -> Iterator[tuple[str, int, tuple[int, ...], int]]:
        """The step of each row from the first on; each block is expanded backward from the vector behind it."""
        head = len(symbols) % self.block
        start = 0
        for end, behind in zip(range(head, len(symbols) + 1, self.block), vectors, strict=True):
            inner = []
            for sym in reversed(symbols[start:end]):
                inner.append(behind)
                behind = self.before[behind][sym]
            for sym, after in zip(symbols[start:end], reversed(inner), strict=True):
                step = self.steps[after][sym][state]
                state = step[1]
                yield step
            start = end

    def every(self, symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
        """For every vector behind: the vector before, the cost grown, and the state after from each state (a row of STATES)."""
        count = len(self.vectors)
        head, codes = self._blocks(symbols)
        now, total, kept = np.arange(count), np.zeros(count, np.int64), []
        for code in reversed(codes):
            kept.append(now)
            total += self.block_grown[now, code]
            now = self.block_before[now, code]
        one, one_grown = np.array(self.before), np.array(self.grown)
        after = np.array([[[step[1] for step in row] for row in rows] for rows in self.steps])
        at_head = now
        for sym in reversed(symbols[:head]):
            total += one_grown[now, sym]
            now = one[now, sym]
        state = np.tile(np.arange(STATES), (count, 1))
        start = 0
        for end, behind in zip(range(head, len(symbols) + 1, self.block), [at_head, *reversed(kept)], strict=True):
            inner = []
            for sym in reversed(symbols[start:end]):
                inner.append(behind)
                behind = one[behind, sym]
            for sym, v in zip(symbols[start:end], reversed(inner), strict=True):
                state = after[v[:, None], sym, state]
            start = end
        return now.tolist(), total.tolist(), state.ravel().tolist()


class Faults:
    """Symbols and counts of the rows of a segment; ``fresh``: rows that are no copies."""

    def __init__(self, roles: list[str], texts: list[str], fresh: set[int]):
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.symbols, last = [], None
        for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
            said = text.rstrip(_SPACE)
            cut = said[-1:] not in _STOPS
            if not said:
                self.blank += 1
            elif i not in fresh:
                self.duplicate += 1
            else:
                self.truncated += cut
            self.symbols.append(symbol(role, cut) if said and i in fresh else 0)
            if last is not None and (last, role[:1]) not in _LEGAL:
                self.illegal += 1
            last = role[:1]


def first_places(roles: list[str], texts: list[str]) -> list[int]:
    places: dict[tuple[str, str], int] = {}
    for i, key in enumerate(zip(roles, texts, strict=True)):
        places.setdefault(key, i)
    return list(places.values())


def repaired(tables: Tables, faults: Faults, roles: list[str], texts: list[str], state: int, vectors: list[int], end: bool) -> tuple[str, list[str]]:
    """The audit and the lines of a segment that is entered in ``state``."""
    audit, lines = [], []
    for i, (letters, after, inserted, own) in enumerate(tables.trace(faults.symbols, state, vectors)):
        audit.append(letters)
        lines += [ROLES[r] + ":" for r in inserted]
        if own > -2:
            lines.append(f"{roles[i] if own < 0 else ROLES[own]}:{texts[i]}")
        state = after
    if end:
        letters, _, inserted = tables.ends[state]
        audit.append(letters)
        lines += [ROLES[r] + ":" for r in inserted]
    return "".join(audit), lines


def turn_gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


class _Segment:
    def __init__(self, conv, whole: bool):
        self.conv, self.whole, self.bytes = conv, whole, 0
        self.turns, self.roles, self.texts = [], [], []

    def full(self, rows: int) -> bool:
        return len(self.texts) >= rows or self.bytes >= SEGMENT_BYTES


def _dealt(segment_rows: int):
    """A result row of each conversation that lies in one segment inside the task, the segments of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, part, number = Tables(), TaskContext.get().partitionId(), 0
        names = ["conv_id", "part", "seg", *COUNTS, "cost", "audit", "repaired_sha256", "turns", "roles", "texts"]
        columns, held = [[] for _ in names], 0

        def add(seg: _Segment, whole: bool):
            nonlocal number, held
            if whole:
                f = Faults(seg.roles, seg.texts, set(first_places(seg.roles, seg.texts)))
                vectors, before, cost = tables.cost(f.symbols)
                audit, lines = repaired(tables, f, seg.roles, seg.texts, START, vectors, True)
                row = [seg.conv, None, None, turn_gaps(seg.turns), f.blank, f.duplicate, f.truncated, f.illegal, cost + tables.vectors[before][START],
                       audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), None, None, None]
            else:
                row = [seg.conv, part, number, *[None] * 8, seg.turns, seg.roles, seg.texts]
                number += 1
                held += seg.bytes
            for column, value in zip(columns, row, strict=True):
                column.append(value)

        def out(kind: pa.DataType):
            nonlocal columns, held
            kinds = [kind, pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            columns, held = [[] for _ in names], 0
            return batch

        seg = kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, turn, role, text, times in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "times")), strict=True):
                if seg is None or conv != seg.conv:
                    if seg is not None:
                        add(seg, seg.whole)
                    seg = _Segment(conv, whole=seg is not None)  # the first one of a task may have begun in another
                for _ in range(times):
                    if seg.full(segment_rows):
                        add(seg, False)
                        seg = _Segment(conv, whole=False)
                    seg.turns.append(turn)
                    seg.roles.append(role)
                    seg.texts.append(text)
                    seg.bytes += len(text)
                if len(columns[0]) >= 1000 or held >= 4 * SEGMENT_BYTES:
                    yield out(kind)
        if seg is not None:
            add(seg, False)  # the last one may go on in another task
            yield out(kind)

    return run


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first place in its segment of each (role, text), texts by their SHA-256."""
    for batch in batches:
        rows, places, digests = [], [], []
        for row, (roles, texts) in enumerate(zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist(), strict=True)):
            for place in first_places(roles, texts):
                rows.append(row)
                places.append(place)
                digests.append(hashlib.sha256(f"{len(roles[place])}:{roles[place]}{texts[place]}".encode()).digest())
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(take) for c in ("conv_id", "part", "seg")), pa.array(places, pa.int32()), pa.array(digests, pa.binary())],
            names=["conv_id", "part", "seg", "place", "digest"],
        )


_SUMMARY = "part int, seg int, rows int, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, before array<int>, grown array<long>, after array<int>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The small table of each segment: what it does to every vector behind it and to every state before it."""
    tables = Tables()
    for batch in batches:
        out = [[] for _ in range(13)]
        for turns, roles, texts, fresh in zip(*(batch.column(c).to_pylist() for c in ("turns", "roles", "texts", "fresh")), strict=True):
            f, known = Faults(roles, texts, set(fresh or ())), {t for t in turns if t is not None}
            first, last = (roles[0][:1], roles[-1][:1]) if roles else (None, None)
            row = [len(roles), min(known, default=None), max(known, default=None), len(known), f.blank, f.duplicate, f.truncated, f.illegal, first, last, *tables.every(f.symbols)]
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.int32(), *[pa.int64()] * 7, pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = [c.split()[0] for c in _SUMMARY.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("seg"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["conv_id", *names])


_JOINED = "part int, seg int, behind int, state int, final boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _join_segments(table: pa.Table) -> pa.Table:
    """One conversation's segments: the vector behind and the state before each; the counts of all on each."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seg"]))
    behind, cost, vectors = 0, 0, []
    for r in reversed(rows):
        vectors.append(behind)
        cost += r["grown"][behind]
        behind = r["before"][behind]
    vectors.reverse()
    cost += Tables(1).vectors[behind][START]
    state, states = START, []
    for r, v in zip(rows, vectors, strict=True):
        states.append(state)
        state = r["after"][v * STATES + state]
    total = {k: sum(r[k] for r in rows) for k in COUNTS[1:]}
    last = high = low = None
    turns = 0
    for r in rows:
        if r["rows"]:
            if last is not None and (last, r["first"]) not in _LEGAL:
                total["illegal"] += 1
            last = r["last"]
        if r["turns"]:
            turns += r["turns"] - (r["low"] == high)
            low = r["low"] if low is None else low
            high = r["high"]
    gaps = high - low + 1 - turns if turns else 0
    n = len(rows)
    values = [[r["part"] for r in rows], [r["seg"] for r in rows], vectors, states, [False] * (n - 1) + [True], [gaps] * n, *([total[k]] * n for k in COUNTS[1:]), [cost] * n]
    kinds = [*[pa.int32()] * 4, pa.bool_(), *[pa.int64()] * 6]
    return pa.table([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _JOINED.split(", ")])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and repaired text of each segment."""
    tables = Tables()
    for batch in batches:
        audits, pieces = [], []
        for roles, texts, fresh, behind, state, final in zip(*(batch.column(c).to_pylist() for c in ("roles", "texts", "fresh", "behind", "state", "final")), strict=True):
            f = Faults(roles, texts, set(fresh or ()))
            audit, lines = repaired(tables, f, roles, texts, state, tables.cost(f.symbols, behind)[0], final)
            audits.append(audit)
            pieces.append("\n".join(lines))
        keep = ["conv_id", "part", "seg", *COUNTS, "cost"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(audits, pa.string()), pa.array(pieces, pa.string())], names=[*keep, "audit", "piece"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its segments in order; texts go through the digest and are let go."""
    names = ["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"]
    now, head, audit, digest, begun = None, None, [], None, False
    done = [[] for _ in names]

    def close():
        for column, value in zip(done, [*head, "".join(audit), digest.hexdigest()], strict=True):
            column.append(value)

    for batch in batches:
        keys = [batch.column(c).to_pylist() for c in ("conv_id", *COUNTS, "cost")]
        for i, (letters, piece) in enumerate(zip(batch.column("audit").to_pylist(), batch.column("piece").to_pylist(), strict=True)):
            key = (keys[0][i],)
            if key != now:
                if now is not None:
                    close()
                now, head, audit, digest, begun = key, [k[i] for k in keys], [], hashlib.sha256(), False
            audit.append(letters)
            if piece:
                digest.update(("\n" if begun else "").encode() + piece.encode())
                begun = True
        kind = batch.schema.field("conv_id").type
        yield pa.RecordBatch.from_arrays([pa.array(c, kind if n == "conv_id" else None) if c else pa.array([], _kind(n, kind)) for c, n in zip(done, names, strict=True)], names=names)
        done = [[] for _ in names]
    if now is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, _kind(n, kind)) for c, n in zip(done, names, strict=True)], names=names)


def _kind(name: str, conv: pa.DataType) -> pa.DataType:
    return conv if name == "conv_id" else pa.string() if name in ("audit", "repaired_sha256") else pa.int64()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage, and ``times``: 0 where the row is dropped, 2 where it is repeated."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", (F.crc32(key.cast("binary")) % 20).cast("int").alias("kind"))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate(text, _STOPS, "")).otherwise(text)
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, ROLES[0]).otherwise(role).alias("role"), text.alias("text"), times.alias("times"))


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text, times): counts of faults, cost, audit, repaired_sha256."""
    spark = rows.sparkSession
    small_batches(spark)
    # short keys, as a sample of them goes to the driver; the last one parts rows that are equal
    order = ["conv_id", "turn", "role", "begin", "hash"]
    keyed = rows.withColumns({"begin": F.substring("text", 1, 64), "hash": F.xxhash64("text"), "salt": F.rand(7)})
    dealt = keyed.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "text")
    kind = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType)])
    result = T.StructType([*kind, *T._parse_datatype_string(", ".join(f"{c} long" for c in [*COUNTS, "cost"]) + ", audit string, repaired_sha256 string")])
    more = T._parse_datatype_string("turns array<long>, roles array<string>, texts array<string>")
    ends = T._parse_datatype_string("part int, seg int")
    table = cut_lineage(dealt.mapInArrow(_dealt(segment_rows), T.StructType([*kind, *ends, *result[1:], *more])), "op12-dealt")
    whole = table.where("part IS NULL").select(result.names)

    parts = table.where("part IS NOT NULL").select("conv_id", "part", "seg", "turns", "roles", "texts")
    place = T.StructType([*kind, *ends, *T._parse_datatype_string("place int, digest binary")])
    first = parts.select("conv_id", "part", "seg", "roles", "texts").mapInArrow(_places, place)
    first = first.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "seg", "place")).alias("at")).select("at.*")
    fresh = first.groupBy(F.col("part").alias("p"), F.col("seg").alias("s")).agg(F.collect_list("place").alias("fresh"))  # a segment's rows at most
    parts = cut_lineage(parts.join(fresh, (parts.part == fresh.p) & (parts.seg == fresh.s), "left").drop("p", "s"), "op12-parts")
    summary = parts.mapInArrow(_summaries, T.StructType([*kind, *T._parse_datatype_string(_SUMMARY)]))
    joined = summary.groupBy("conv_id").applyInArrow(_join_segments, _JOINED).withColumnsRenamed({"part": "p", "seg": "s"})
    ready = parts.join(joined, (parts.part == joined.p) & (parts.seg == joined.s)).drop("p", "s")
    pieces = T.StructType([*kind, *ends, *result[1:7], *T._parse_datatype_string("audit string, piece string")])
    ordered = ready.mapInArrow(_traced, pieces).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    return whole.unionByName(ordered.mapInArrow(_digested, result))


def repair_conversations(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    return repair(damaged(conversations), segment_rows)
