"""Operator 11: repair of damaged conversations by the cheapest edits, found by divide and conquer in linear space.

Roles of a repaired conversation alternate as (s?(ua)+)?, by their initials. Of its four states (start, after s, after u,
after a) each row leads from one to another: kept as it is (K, 0), with the role made user or assistant (R, 1), or deleted
(D, 2; blank and duplicate rows must be); a truncated row that stays adds 5. Before a row, and at the end, rows without
text may be inserted (I, 5 each). Of the cheapest edits those with the ASCII-least initials are taken.

A row's kind (initial, fault) gives a table of costs from state to state, and among equal costs and one first state an
order of the second states by their edits: edits up to a row end in that row's own letter, so none begins with another,
and orders of neighbours are put together like costs are. `solve` meets in the middle (Hirschberg): costs and orders from
the front, costs from the back, the least crossing of the cheapest, then both halves alike.

Rows are sorted once by (conversation, turn, role, text) into ranges, which cut conversations of any size. A task puts the
tables of a conversation's rows in its range together as they come; per conversation there is one table a range, whose
states at the cuts are solved; then each range solves its own rows. So a conversation that holds a third of all rows is
worked on wherever its rows are. Only its SHA-256, a chain by definition, passes over its texts in one task, as a stream.

Edge cases: null conv_id is a conversation; a null turn comes first, a null role or text counts as one space; rows of one
turn are ordered by role and a digest of the text; a repaired conversation may be empty; an empty table gives an empty
result. Roles are told by their first character, case and all. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text
from .shared import Tables

START, S, U, A = range(4)
NEXT = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 60
#: Of a row: no fault, must go, is truncated.
FINE, GOES, CUT = range(3)
_SPACE = " \t\n\x0b\x0c\r"


def _made(state: int) -> tuple[str, int]:
    """The role that is inserted or given in a state, and the next state."""
    return ("assistant", A) if state == U else ("user", U)


class Table:
    """Costs of the cheapest edits from state to state, and for each first state the place of each second one in the
    order of their edits."""

    __slots__ = ("cost", "place")

    def __init__(self, cost: Sequence[Sequence[int]], place: Sequence[Sequence[int]]):
        self.cost, self.place = cost, place


def _ranked(found: list[tuple[int, tuple] | None]) -> tuple[list[int], list[int]]:
    keys = sorted(f[1] for f in found if f)
    return [f[0] if f else NEVER for f in found], [keys.index(f[1]) if f else 4 for f in found]


def _row_edits(initial: str, fault: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> the cheapest edits of a row and what is inserted before it."""
    best: dict = {}
    for start in range(4):
        state = start
        for inserted in range(3):
            ways = [(state, DELETE, "D")]
            if fault != GOES:
                extra = TRUNCATED if fault == CUT else 0
                if initial in NEXT[state]:
                    ways.append((NEXT[state][initial], KEEP + extra, "K"))
                ways.append((_made(state)[1], REROLE + extra, "R"))
            for end, cost, letter in ways:
                way = (cost + inserted * INSERT, "I" * inserted + letter)
                best[start, end] = min(best.get((start, end), way), way)
            state = _made(state)[1]
    return best


#: Kinds of rows: 3 times the initial's place, plus the fault; other initials are the last.
INITIALS = "sua"
EDITS = [_row_edits(i, f) for i in (*INITIALS, "-") for f in (FINE, GOES, CUT)]
ROWS = [Table(*zip(*(_ranked([e.get((p, q)) for q in range(4)]) for p in range(4)), strict=True)) for e in EDITS]
#: What is inserted at the end.
AT_END = [0, 2 * INSERT, INSERT, 0]


def joined(x: Table, y: Table) -> Table:
    cost, place = [], []
    for p in range(4):
        found: list = []
        for q in range(4):
            ways = [(x.cost[p][r] + y.cost[r][q], x.place[p][r], r) for r in range(4) if x.cost[p][r] < NEVER and y.cost[r][q] < NEVER]
            best = min(ways, default=None)
            found.append(best and (best[0], (best[1], y.place[best[2]][q])))
        c, o = _ranked(found)
        cost.append(c)
        place.append(o)
    return Table(cost, place)


def _front(tables: Sequence[Table], start: int) -> tuple[list[int], list[int]]:
    """Costs of the four states after the tables, and their places in the order of the edits."""
    cost, place = [NEVER] * 4, [0] * 4
    cost[start] = 0
    for t in tables:
        found: list = []
        for q in range(4):
            ways = [(cost[p] + t.cost[p][q], place[p], t.place[p][q]) for p in range(4) if cost[p] < NEVER and t.cost[p][q] < NEVER]
            best = min(ways, default=None)
            found.append(best and (best[0], best[1:]))
        cost, place = _ranked(found)
    return cost, place


def _back(tables: Sequence[Table], end: Sequence[int]) -> list[int]:
    cost = list(end)
    for t in reversed(tables):
        cost = [min(t.cost[p][q] + cost[q] for q in range(4)) for p in range(4)]
    return cost


def _crossing(front: tuple[list[int], list[int]], back: Sequence[int]) -> int:
    return min((c + b, o, q) for q, (c, o, b) in enumerate(zip(*front, back, strict=True)))[2]


def solve(tables: Sequence[Table], start: int = START, end: int | None = None) -> list[int]:
    """The states after each table on the cheapest way from `start` to `end` (None: wherever the end costs least), of
    equal ones the least by edits."""
    if not tables:
        return []
    if end is None:
        end = _crossing(_front(tables, start), AT_END)
    out, todo = [0] * len(tables), [(0, len(tables), start, end)]
    while todo:
        lo, hi, p, q = todo.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        cross = _crossing(_front(tables[lo:mid], p), _back(tables[mid:hi], [0 if r == q else NEVER for r in range(4)]))
        todo += [(lo, mid, p, cross), (mid, hi, cross, q)]
    return out


# ---- damage and faults


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, each row dropped, emptied, robbed of its full stops, repeated, made the user's, or left,
    by crc32(conv_id:turn) % 20."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), F.pmod(F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))), F.lit(20)).alias("_d"))
    rows = rows.where("_d <> 0").withColumn("text", F.when(F.col("_d") == 1, F.lit("")).when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_d") == 4, F.lit("user")).otherwise(F.col("role")))
    return rows.withColumn("_n", F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def _place_in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 40
    for b in batches:
        yield b.append_column("ord", pa.array(range(at, at + b.num_rows), pa.int64()))
        at += b.num_rows


def sorted_rows(rows: DataFrame, t: Tables) -> DataFrame:
    """The rows written in ranges of (conv_id, turn, role, digest), with `ord`, the range above 40 bits of the place in it."""
    rows = rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    # rows that are equal in all of it may be dealt out by any order
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, "_any").sortWithinPartitions(*keys).drop("_any")
    schema = ", ".join(f"`{c}` {k}" for c, k in ranges.dtypes)
    return t.put(ranges.mapInArrow(_place_in_range, f"{schema}, ord long"), "sorted")


def _ends(c: Column) -> Column:
    """FINE, GOES if blank, CUT if its last character that is no white space is none of .!?"""
    kept = F.rtrim(c, F.lit(_SPACE))
    return F.when(kept == "", F.lit(GOES)).when(F.substring(kept, -1, 1).isin(".", "!", "?"), F.lit(FINE)).otherwise(F.lit(CUT))


def row_kinds(rows: DataFrame) -> DataFrame:
    """Sorted rows -> conv_id, ord, turn, initial, kind, and the first fault as blank, duplicate, truncated or null."""
    narrow = rows.select("conv_id", "ord", "turn", F.substring("role", 1, 1).alias("initial"), "digest", _ends(F.col("text")).alias("fault"))
    firsts = narrow.where(F.col("fault") != GOES).groupBy("conv_id", "digest").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("_c"), F.col("digest").alias("_g"), "first")
    seen = narrow.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_g")), "left")
    again = F.coalesce(F.col("ord") > F.col("first"), F.lit(False)) & (F.col("fault") != GOES)
    said = F.when(F.col("fault") == GOES, F.lit("blank")).when(again, F.lit("duplicate")).when(F.col("fault") == CUT, F.lit("truncated"))
    place = F.instr(F.lit(INITIALS), F.col("initial"))
    kind = 3 * F.when((place == 0) | (F.col("initial") == ""), F.lit(len(INITIALS))).otherwise(place - 1) + F.when(again, F.lit(GOES)).otherwise(F.col("fault"))
    return seen.select("conv_id", "ord", "turn", "initial", kind.cast("int").alias("kind"), said.alias("fault"))


# ---- up: one table for each conversation and range


def _segments(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[list]]]:
    """Runs of rows of one conversation and one range: (range, a list of lists a column), in pieces; a piece that goes on
    has the key of the one before."""
    for b in batches:
        columns = [b.column(n).to_pylist() for n in names]
        heads = [0]
        conv, ord_ = columns[0], columns[1]
        for i in range(1, b.num_rows):
            if conv[i] != conv[i - 1] or ord_[i] >> 40 != ord_[i - 1] >> 40:
                heads.append(i)
        for i, j in zip(heads, [*heads[1:], b.num_rows], strict=True):
            if j > i:
                yield ord_[i] >> 40, [c[i:j] for c in columns]


#: Rows whose tables are put together at once, and looked up if they were before.
_FEW = 8
_LEGAL = {"su", "ua", "au"}


class _Sum:
    """A conversation's rows in a range, put together as they come."""

    def __init__(self, part: int, columns: list[list]):
        self.part, self.conv, self.first = part, columns[0][0], columns[1][0]
        self.table, self.faults, self.illegal = None, dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0
        self.turns, self.first_turn, self.turn, self.least, self.head, self.last = 0, None, None, None, columns[3][0], None

    def add(self, columns: list[list], known: dict) -> None:
        _, _, turns, initials, kinds, faults = columns
        for k in range(0, len(kinds), _FEW):
            key = tuple(kinds[k : k + _FEW])
            if key not in known:
                made = ROWS[key[0]]
                for x in key[1:]:
                    made = joined(made, ROWS[x])
                if len(known) > 100_000:
                    known.clear()
                known[key] = made
            self.table = known[key] if self.table is None else joined(self.table, known[key])
        for f in faults:
            if f:
                self.faults[f] += 1
        for x in initials:
            self.illegal += self.last is not None and self.last + x not in _LEGAL
            self.last = x
        for x in turns:
            if x is not None and x != self.turn:
                self.turns += 1
                self.least = x if self.least is None else self.least
                self.turn = x

    def row(self) -> dict:
        t = self.table
        return {"conv_id": self.conv, "part": self.part, "first": self.first, "cost": [x for r in t.cost for x in r], "place": [x for r in t.place for x in r], **self.faults, "illegal": self.illegal, "head": self.head, "last": self.last, "turns": self.turns, "least": self.least, "greatest": self.turn}


_SUMS = "part long, first long, cost array<long>, place array<long>, blank long, duplicate long, truncated long, illegal long, head string, last string, turns long, least long, greatest long"


def _up(kind: pa.DataType):
    n = pa.int64()
    schema = pa.schema([("conv_id", kind), ("part", n), ("first", n), ("cost", pa.list_(n)), ("place", pa.list_(n)), *[(x, n) for x in ("blank", "duplicate", "truncated", "illegal")], ("head", pa.string()), ("last", pa.string()), ("turns", n), ("least", n), ("greatest", n)])

    def work(batches):
        known, now, out = {}, None, []
        for part, columns in _segments(batches, ["conv_id", "ord", "turn", "initial", "kind", "fault"]):
            if now is None or (now.part, now.conv) != (part, columns[0][0]):
                if now:
                    out.append(now.row())
                now = _Sum(part, columns)
            now.add(columns, known)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now:
            out.append(now.row())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return work


# ---- top: the states at the cuts, and what a conversation comes to


def _at_cuts(kind: pa.DataType):
    n = pa.int64()
    schema = pa.schema([("conv_id", kind), ("part", n), ("start", n), ("end", n), ("total", n), ("illegal_between", n), ("turns_between", n)])

    def solved(conv, rows: list[dict]) -> list[dict]:
        rows.sort(key=lambda r: r["part"])
        tables = [Table([r["cost"][4 * p : 4 * p + 4] for p in range(4)], [r["place"][4 * p : 4 * p + 4] for p in range(4)]) for r in rows]
        ends = solve(tables)
        starts = [START, *ends[:-1]]
        total = sum(t.cost[p][q] for t, p, q in zip(tables, starts, ends, strict=True)) + AT_END[ends[-1]]
        illegal, twice, turn = 0, 0, None
        for before, r in itertools.pairwise(rows):
            illegal += before["last"] + r["head"] not in _LEGAL
        for r in rows:
            twice += r["least"] is not None and r["least"] == turn
            turn = r["greatest"] if r["greatest"] is not None else turn
        return [{"conv_id": conv, "part": r["part"], "start": p, "end": q, "total": total if k == 0 else 0, "illegal_between": illegal if k == 0 else 0, "turns_between": twice if k == 0 else 0} for k, (r, p, q) in enumerate(zip(rows, starts, ends, strict=True))]

    def work(batches):
        for b in batches:
            out = [x for r in b.to_pylist() for x in solved(r["conv_id"], r["rows"])]
            yield pa.RecordBatch.from_pylist(out, schema)

    return work


# ---- down: each row's edits


def _down(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), ("ord", pa.int64()), ("edits", pa.string())])

    def edits(ords: list[int], kinds: bytearray, start: int, end: int, known: dict) -> list[str]:
        key = (bytes(kinds), start, end) if len(kinds) <= _FEW else None
        if key in known:
            return known[key]
        ends = solve([ROWS[k] for k in kinds], start, end)
        out = [EDITS[k][p, q][1] for k, p, q in zip(kinds, [start, *ends[:-1]], ends, strict=True)]
        if key:
            if len(known) > 100_000:
                known.clear()
            known[key] = out
        return out

    def work(batches):
        known, now, states, ords, kinds = {}, None, None, [], bytearray()
        convs: list = []
        made: list = []

        def finished():
            convs.extend([now[1]] * len(ords))
            made.extend(edits(ords, kinds, *states, known))

        held: list = []
        for part, c in _segments(batches, ["conv_id", "ord", "kind", "start", "end"]):
            key = (part, c[0][0])
            if key != now:
                if now:
                    finished()
                    held.extend(ords)
                    if len(held) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(held, pa.int64()), pa.array(made, pa.string())], schema=schema)
                        convs, made, held = [], [], []
                now, states, ords, kinds = key, (c[3][0], c[4][0]), [], bytearray()
            ords.extend(c[1])
            kinds.extend(c[2])
        if now:
            finished()
            held.extend(ords)
            yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(held, pa.int64()), pa.array(made, pa.string())], schema=schema)

    return work


class Repair:
    """What `repair` found: `rows` (sorted, with ord), `edits` (conv_id, ord, edits: what is inserted before the row, and
    the row's own letter) and `summary` (a row for each conversation that has rows)."""

    def __init__(self, rows: DataFrame, edits: DataFrame, summary: DataFrame):
        self.rows, self.edits, self.summary = rows, edits, summary


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def repair(conversations: DataFrame) -> Repair:
    """conv_id, turn (integer), role, text -> the cheapest edits of each conversation."""
    spark = conversations.sparkSession
    t = Tables(spark, "repair")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = sorted_rows(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text")), t)
    kind, name = _arrow(rows, "conv_id"), rows.schema["conv_id"].dataType.simpleString()
    kinds = t.put(row_kinds(rows).withColumn("part", F.shiftright("ord", 40)), "kinds")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_range = lambda df: df.repartition(parts, "part").sortWithinPartitions("ord")
    sums = t.put(by_range(kinds).mapInArrow(_up(kind), f"conv_id {name}, {_SUMS}"), "sums")
    # at most one row for each conversation and range
    lists = sums.groupBy("conv_id").agg(F.collect_list(F.struct("part", "cost", "place", "head", "last", "least", "greatest")).alias("rows"))
    cuts = t.put(lists.mapInArrow(_at_cuts(kind), f"conv_id {name}, part long, start long, end long, total long, illegal_between long, turns_between long"), "cuts")
    ends = cuts.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "start", "end")
    met = kinds.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))).select("conv_id", "ord", "kind", "start", "end", "part")
    edits = t.put(by_range(met).mapInArrow(_down(kind), f"conv_id {name}, ord long, edits string"), "edits")
    some = sums.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")], F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    more = cuts.groupBy(F.col("conv_id").alias("_c")).agg(F.sum("total").alias("cost"), F.sum("illegal_between").alias("i"), F.sum("turns_between").alias("d"))
    both = some.join(more, F.col("conv_id").eqNullSafe(F.col("_c")))
    gaps = F.coalesce(F.col("greatest") - F.col("least") + 1 - (F.col("turns") - F.col("d")), F.lit(0))
    return Repair(rows, edits, both.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.col("i")).alias("illegal"), "cost"))


def _stream(found: Repair, work, schema: str) -> DataFrame:
    """Rows and their edits, conversation by conversation in their order, through `work`."""
    none = F.lit(None).cast("string")
    said = found.edits.select("conv_id", "ord", "edits", none.alias("role"), none.alias("text")).union(found.rows.select("conv_id", "ord", none.alias("edits"), "role", "text"))
    return said.repartition("conv_id").sortWithinPartitions("conv_id", "ord", F.col("edits").desc_nulls_last()).mapInArrow(work, schema)


class _Walk:
    """Follows the states along edits, and says which rows come of them: (edit, role, text or None for the row's own)."""

    def __init__(self):
        self.state = START

    def inserted(self) -> tuple[str, str, str]:
        role, self.state = _made(self.state)
        return "I", role, ""

    def row(self, edits: str, role: str, said: str) -> Iterator[tuple[str, str, str]]:
        for e in edits:
            if e == "I":
                yield self.inserted()
            elif e == "K":
                self.state = NEXT[self.state][role[0]]
                yield e, role, said
            elif e == "R":
                own, self.state = _made(self.state)
                yield e, own, said

    def end(self) -> Iterator[tuple[str, str, str]]:
        while AT_END[self.state]:
            yield self.inserted()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str, str] | None]:
    """(conv_id, edits, role, text) of each row; None after a conversation's last."""
    now, edits, open_ = None, "", False
    for b in batches:
        for conv, said, role, body in zip(*(b.column(c).to_pylist() for c in ("conv_id", "edits", "role", "text")), strict=True):
            if said is not None:
                if open_ and conv != now:
                    yield None
                now, edits, open_ = conv, said, True
            else:
                yield conv, edits, role, body
    if open_:
        yield None


def digests(found: Repair) -> DataFrame:
    """conv_id, audit, repaired_sha256 of `role:text` lines. The digest is a stream; the audit is as long as its rows."""
    kind, name = _arrow(found.rows, "conv_id"), found.rows.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", kind), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    @text.tidy
    def work(batches):
        walk, audit, sha, any_, conv, out = _Walk(), [], hashlib.sha256(), False, None, []

        def put(rows):
            nonlocal any_
            for _, role, said in rows:
                sha.update(f"{chr(10) if any_ else ''}{role}:{said}".encode())
                any_ = True

        for x in _merged(batches):
            if x is None:
                tail = list(walk.end())
                put(tail)
                out.append({"conv_id": conv, "audit": "".join(audit) + "I" * len(tail), "repaired_sha256": sha.hexdigest()})
                walk, audit, sha, any_ = _Walk(), [], hashlib.sha256(), False
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            else:
                conv = x[0]
                audit.append(x[1])
                put(walk.row(*x[1:]))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return _stream(found, work, f"conv_id {name}, audit string, repaired_sha256 string")


def repaired(found: Repair) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), edit (K, R or I), role, text."""
    kind, name = _arrow(found.rows, "conv_id"), found.rows.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    @text.tidy
    def work(batches):
        walk, place, conv, out, size = _Walk(), 0, None, [], 0
        for x in _merged(batches):
            conv = conv if x is None else x[0]
            for edit, role, said in walk.end() if x is None else walk.row(*x[1:]):
                out.append({"conv_id": conv, "place": place, "edit": edit, "role": role, "text": said})
                place, size = place + 1, size + len(said)
            if x is None:
                walk, place = _Walk(), 0
            if size >= text.SLICE_BYTES or len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return _stream(found, work, f"conv_id {name}, place long, edit string, role string, text string")


def op11(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair(damaged(rows))
    every = rows.select("conv_id").distinct()
    keyed = lambda df, k: df.withColumnRenamed("conv_id", k)
    out = every.join(keyed(found.summary, "_s"), F.col("conv_id").eqNullSafe(F.col("_s")), "left").join(keyed(digests(found), "_d"), F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
