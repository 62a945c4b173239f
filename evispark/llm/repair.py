"""Repair of conversation structure: cheapest edits found by searching the edit lattice from both ends.

A node of the lattice is a number of rows taken and a state of the wanted order of roles, ``(s?(ua)+)?``.  Keep, rerole and
delete take a row, insert takes none.  From a state each letter leads to one node only, so an audit names one path.
Forward and reverse heaps meet; all crossings of equal cost are finished before the least audit is read off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from .common import is_small

#: A conversation is handled in blocks of so many rows and bytes of text; most are one block.
BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
FAR = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

# States: nothing yet, behind the system turn, behind a user's, behind an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
WANTED = (USER, USER, ASSISTANT, USER)                 # what an insert or a rerole adds in each state
BEFORE = ((), (), (NOTHING, SYSTEM, ASSISTANT), (USER,))
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
KEPT_BEFORE = {(to, c): tuple(s for (s, d), t in KEPT.items() if (t, d) == (to, c)) for (_, c), to in KEPT.items()}
#: What is left to pay at the end, by state: the inserts that finish a turn.
ENDING, FINISH = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\x0b\x0c\r"


class Lattice:
    """Edits of a block of rows, one character each: the role's initial (x: none that counts), in upper case if the text is
    truncated; d if the row must go."""

    def __init__(self, codes: str, entry: int, ends: tuple[int, ...]):
        self.codes, self.m, self.entry, self.ends = codes, len(codes), entry, ends
        self.ahead, self.behind, self.best = self._search()

    def _onward(self, node: int) -> list[tuple[str, int, int]]:
        """Letter, node and cost of each edit, letters in order.  Inserts at the end belong to what follows."""
        if node >> 2 == self.m:
            return []
        state, code = node & 3, self.codes[node >> 2]
        row, extra = (node | 3) + 1, TRUNCATED if code.isupper() else 0
        out = [("D", node + 4, DELETE), ("I", node - state + WANTED[state], INSERT)]
        if code != "d":
            to = KEPT.get((state, code.lower()))
            if to is not None:
                out.append(("K", row + to, KEEP + extra))
            out.append(("R", row + WANTED[state], REROLE + extra))
        return out

    def _back(self, node: int) -> list[tuple[int, int]]:
        """Nodes before, with the cost from there."""
        state, row, out = node & 3, node - (node & 3), []
        if row >> 2 < self.m:
            out += [(row + s, INSERT) for s in BEFORE[state]]
        if row:
            code = self.codes[(row >> 2) - 1]
            extra = TRUNCATED if code.isupper() else 0
            out.append((node - 4, DELETE))
            if code != "d":
                out += [(row - 4 + s, REROLE + extra) for s in BEFORE[state]]
                out += [(row - 4 + s, KEEP + extra) for s in KEPT_BEFORE.get((state, code.lower()), ())]
        return out

    def _search(self) -> tuple[dict[int, int], dict[int, int], int]:
        """Settled distances from the entry and to the end, and the least cost: until no crossing can be as cheap any more."""
        ahead: dict[int, int] = {}
        behind: dict[int, int] = {}
        seen, left = {self.entry: 0}, {4 * self.m + s: cost for s, cost in enumerate(self.ends) if cost < FAR}
        front, rear, best = [(0, self.entry)], [(cost, node) for node, cost in left.items()], FAR
        heapify(rear)
        while front and rear and front[0][0] + rear[0][0] <= best:
            if front[0][0] <= rear[0][0]:
                cost, node = heappop(front)
                if node in ahead:
                    continue
                ahead[node] = cost
                best = min(best, cost + left.get(node, FAR))
                for _, to, paid in self._onward(node):
                    if cost + paid < seen.get(to, FAR):
                        seen[to] = cost + paid
                        heappush(front, (cost + paid, to))
                        best = min(best, cost + paid + left.get(to, FAR))
            else:
                cost, node = heappop(rear)
                if node in behind:
                    continue
                behind[node] = cost
                best = min(best, cost + seen.get(node, FAR))
                for to, paid in self._back(node):
                    if cost + paid < left.get(to, FAR):
                        left[to] = cost + paid
                        heappush(rear, (cost + paid, to))
                        best = min(best, cost + paid + seen.get(to, FAR))
        return ahead, behind, best

    def audit(self) -> tuple[str, int]:
        """The least of the cheapest audits, and the state it ends in: the way through all crossings, least letter first."""
        ahead, behind, best = self.ahead, self.behind, self.best
        crossing = [u for u, cost in ahead.items() if u >> 2 == self.m and cost + self.ends[u & 3] == best or any(
            to in behind and cost + paid + behind[to] == best for _, to, paid in self._onward(u))]
        good = set(crossing)                    # forward nodes that a cheapest path goes through
        while crossing:
            node = crossing.pop()
            for u, paid in self._back(node):
                if u not in good and u in ahead and ahead[u] + paid == ahead[node]:
                    good.add(u)
                    crossing.append(u)
        node, cost, letters = self.entry, 0, []
        while node >> 2 < self.m:
            for letter, to, paid in self._onward(node):
                if to in behind and cost + paid + behind[to] == best or to in good and cost + paid == ahead[to]:
                    break
            node, cost = to, cost + paid
            letters.append(letter)
        return "".join(letters), node & 3


@lru_cache(1 << 14)
def walk(codes: str, entry: int = NOTHING, ends: tuple[int, ...] = ENDING) -> tuple[str, int, int]:
    """Audit, state at the end and cost of a block, what is left to pay behind it included."""
    lattice = Lattice(codes, entry, ends)
    return (*lattice.audit(), lattice.best)


def distances(codes: str) -> list[int]:
    """Least cost of a block from each state to each state, row by row."""
    return [Lattice(codes, a, tuple(0 if s == b else FAR for s in range(4))).best for a in range(4) for b in range(4)]


def judged(rows: list[tuple[str, str]], again: list[bool]) -> tuple[str, list[int]]:
    """A code per row, and the numbers of blank, duplicate and truncated rows; the first fault of a row counts."""
    codes, faults = [], [0, 0, 0]
    for (role, text), seen in zip(rows, again):
        code, end = role[:1] if role[:1] in ("s", "u", "a") else "x", text.rstrip(SPACES)
        if not end:
            faults[0] += 1
            code = "d"
        elif seen:
            faults[1] += 1
            code = "d"
        elif end[-1] not in ".!?":
            faults[2] += 1
            code = code.upper()
        codes.append(code)
    return "".join(codes), faults


def applied(rows: list[tuple[str, str]], audit: str, entry: int = NOTHING) -> list[dict]:
    """The rows after the edits of an audit."""
    out, state, at = [], entry, 0
    for letter in audit:
        if letter != "I":
            role, text = rows[at]
            at += 1
        if letter == "D":
            continue
        if letter == "K":
            out.append({"role": role, "text": text, "edit": "K"})
            state = KEPT[state, role[:1]]
            continue
        state = WANTED[state]
        out.append({"role": NAMES[state], "text": "" if letter == "I" else text, "edit": letter})
    return out


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


TURNS = "array<struct<role:string,text:string,edit:string>>"
PART = f"part long, block long, n_rows long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns {TURNS}"
_FIELDS = ["part", "block", "n_rows", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"]


def _emitted(rows: list[list], id_type: pa.DataType) -> pa.RecordBatch:
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))
    types = [id_type, *[pa.int64()] * 8, pa.string(), turn]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["id", *_FIELDS])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of a sorted partition as they stand: key, then the other columns."""
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))


def _whole(id_type: pa.DataType):
    """Conversations of one block: each is judged and repaired when its rows have passed."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0

        def close(key, rows):
            seen, again = set(), []
            for row in rows:
                again.append(row in seen)
                seen.add(row)
            codes, faults = judged(rows, again)
            audit, state, cost = walk(codes)
            audit += FINISH[state]
            out.append([key, 0, 0, len(rows), *faults, illegal([r[:1] for r, _ in rows]), cost, audit, applied(rows, audit)])
        key, rows, begun = None, [], False
        for id_, role, text in _stretches(batches):
            if begun and id_ != key:
                close(key, rows)
                rows = []
                if held > BLOCK_BYTES or len(out) >= BLOCK_ROWS:
                    yield _emitted(out, id_type)
                    out, held = [], 0
            key, begun = id_, True
            rows.append((role, text))
            held += len(text)
        if begun:
            close(key, rows)
        if out:
            yield _emitted(out, id_type)
    return work


def _cut(id_type: pa.DataType):
    """Long conversations, in order over all partitions: blocks of rows, each with digests that tell repeated rows."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, block, key, rows, size = TaskContext.get().partitionId(), 0, None, [], 0

        def closed():
            digests = [hashlib.blake2b(repr(r).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for r in rows]
            turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            return pa.RecordBatch.from_arrays([
                pa.array([key], id_type), pa.array([part], pa.int64()), pa.array([block], pa.int64()),
                pa.array([[{"role": r, "text": t} for r, t in rows]], turn), pa.array([digests], pa.list_(pa.string()))],
                ["id", "part", "block", "rows", "digests"])
        for id_, role, text in _stretches(batches):
            if rows and (id_ != key or len(rows) >= BLOCK_ROWS or size + len(text) > BLOCK_BYTES):
                yield closed()
                block, rows, size = block + 1, [], 0
            key = id_
            rows.append((role, text))
            size += len(text)
        if rows:
            yield closed()
    return work


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from its last to its first: what is left to pay behind each, by state."""
    key, begun, ends = None, False, ENDING
    for id_, part, block, table in _stretches(batches):
        if not begun or id_ != key:
            key, begun, ends = id_, True, ENDING
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([list(ends)], pa.list_(pa.int64()))],
                                         ["part", "block", "ends"])
        ends = tuple(min(FAR, min(table[4 * s + t] + ends[t] for t in range(4))) for s in range(4))


def _forward(id_type: pa.DataType):
    """Blocks of a conversation from first to last: in the state it is entered in, each has its audit already."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begun, state, initial, held = None, False, NOTHING, "", None
        for id_, part, block, rows, faults, audits, exits, costs in _stretches(batches):
            rows = [(r["role"], r["text"]) for r in rows]
            initials = [r[:1] for r, _ in rows]
            if begun and id_ == key:
                initials, at = [initial, *initials], (part, block)
                yield _emitted([held], id_type)
            else:
                if held:
                    yield _emitted([_ended(held, state)], id_type)
                state, at = NOTHING, (part, block)
            audit = audits[state]
            cost = sum({"D": DELETE, "I": INSERT, "R": REROLE, "K": KEEP}[c] for c in audit)
            held = [id_, *at, len(rows), *faults[:3], illegal(initials), cost, audit, applied(rows, audit, state)]
            held[8] += costs[state]
            key, begun, initial, state = id_, True, initials[-1], exits[state]
        if held:
            yield _emitted([_ended(held, state)], id_type)
    return work


def _ended(part: list, state: int) -> list:
    """The last block of a conversation, with the inserts that finish its last turn."""
    part[8] += ENDING[state]
    part[9] += FINISH[state]
    for _ in FINISH[state]:
        state = WANTED[state]
        part[10].append({"role": NAMES[state], "text": "", "edit": "I"})
    return part


def _repeats(blocks: DataFrame) -> DataFrame:
    """Rows of long conversations that occurred before: ``part``, ``block``, ``again`` (their places in the block)."""
    marks = blocks.select("id", "part", "block", F.posexplode("digests").alias("at", "digest"))
    first = marks.groupBy("id", "digest").agg(F.min(F.struct("part", "block", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = checkpointed(first.select(F.col("id").alias("own"), F.col("digest").alias("same"), "first"))
    met = F.col("id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("same")) & (F.struct("part", "block", "at") > F.col("first"))
    later = marks.join(F.broadcast(first) if is_small(first, 96) else first, met)
    return later.groupBy("part", "block").agg(F.collect_list("at").alias("again"))     # a block has a bounded number of rows


def _long(rows: DataFrame, id_field: T.StructField, id_type: pa.DataType) -> DataFrame:
    """Conversations over the bounds of a block.

    Their rows are dealt to partitions by order, so that none holds a whole conversation, and cut into blocks.  Costs
    between the states of each block (16 numbers) are worked out block by block; one pass from the last block to the first
    adds them up; every block then has its audits for the four states it may be entered in; one pass forward chooses.
    """
    order = ["id", F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    dealt = rows.withColumn("salt", F.monotonically_increasing_id())
    block = T.StructType([id_field, *T._parse_datatype_string(
        "part long, block long, rows array<struct<role:string,text:string>>, digests array<string>").fields])
    blocks = checkpointed(dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "role", "text").mapInArrow(_cut(id_type), block))
    again = checkpointed(_repeats(blocks))

    @F.pandas_udf("codes string, faults array<long>")
    def coded(turns, repeats):
        import pandas as pd
        out = []
        for block_rows, places in zip(turns, repeats):
            marks = [False] * len(block_rows)
            for at in places if places is not None else ():
                marks[at] = True
            out.append(judged([(r["role"], r["text"]) for r in block_rows], marks))
        return pd.DataFrame(out, columns=["codes", "faults"])

    @F.pandas_udf("array<long>")
    def tables(codes):
        import pandas as pd
        return pd.Series([distances(c) for c in codes], dtype=object)

    @F.pandas_udf("audits array<string>, exits array<int>, extra array<long>")
    def walked(codes, ends):
        import pandas as pd
        out = []
        for c, e in zip(codes, ends):
            found = [walk(c, s, tuple(int(x) for x in e)) for s in range(4)]
            extra = [TRUNCATED * _truncated_kept(c, a) for a, _, _ in found]
            out.append(([a for a, _, _ in found], [x for _, x, _ in found], extra))
        return pd.DataFrame(out, columns=["audits", "exits", "extra"])

    known = checkpointed(blocks.join(again, ["part", "block"], "left").select("id", "part", "block", coded("rows", "again").alias("c")).select(
        "id", "part", "block", "c.codes", "c.faults"))
    there = known.select("id", "part", "block", tables("codes").alias("table"))
    ends = there.repartition("id").sortWithinPartitions("id", F.desc("part"), F.desc("block")).mapInArrow(
        _ends, "part long, block long, ends array<long>")
    ways = checkpointed(known.join(ends, ["part", "block"]).select("part", "block", "faults", walked("codes", "ends").alias("w")))
    ready = blocks.drop("digests").join(ways, ["part", "block"]).select("id", "part", "block", "rows", "faults", "w.audits", "w.exits", "w.extra")
    out = T.StructType([id_field, *T._parse_datatype_string(PART).fields])
    return ready.repartition("id").sortWithinPartitions("id", "part", "block").mapInArrow(_forward(id_type), out)


def _truncated_kept(codes: str, audit: str) -> int:
    """How many truncated rows an audit keeps."""
    rows = [a for a in audit if a != "I"]
    return sum(c.isupper() and a != "D" for c, a in zip(codes, rows))


def repair(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
           text_column: str = "text") -> DataFrame:
    """Conversations in the order of their turns, repaired: one row per block of a conversation.

    ``id``, ``part`` and ``block`` (the order of a conversation's blocks), ``alone`` (whether the block is all of it), ``n_rows``,
    ``blank``, ``duplicate``, ``truncated`` (rows by their first fault), ``illegal`` (neighbouring roles that may not follow each
    other), ``cost``, ``audit`` (an initial per edit) and ``turns`` (role, text and edit of the repaired rows).

    Null roles and texts count as one space, null turns come first; rows of equal turn are ordered by role and text, and rows
    equal in all are repeats.  A null id is a conversation of its own.  An empty table gives no rows; other columns are not
    read.  Conversations of any length are handled: beyond a block's bounds, their blocks are searched by themselves.
    """
    field = turns.schema[id_column]
    id_field = T.StructField("id", field.dataType)
    id_type = _arrow_type(field.dataType)
    rows = turns.select(F.col(id_column).alias("id"), F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text_column), F.lit(" ")).alias("text"))
    sizes = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    long = checkpointed(sizes.where((F.col("n") > BLOCK_ROWS) | (F.col("size") > BLOCK_BYTES)).select(F.col("id").alias("long")))
    some = long.limit(1).count() > 0
    met = F.col("id").eqNullSafe(F.col("long"))
    side = F.broadcast(long) if some and is_small(long, 48) else long
    short = rows.join(side, met, "left_anti") if some else rows
    schema = T.StructType([id_field, *T._parse_datatype_string(PART).fields])
    order = ["id", F.col("turn").asc_nulls_first(), "role", "text"]
    found = short.repartition("id").sortWithinPartitions(*order).select("id", "role", "text").mapInArrow(_whole(id_type), schema).withColumn(
        "alone", F.lit(True))
    if some:
        found = found.unionByName(_long(rows.join(side, met, "left_semi"), id_field, id_type).withColumn("alone", F.lit(False)))
    return found


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def gaps(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn") -> DataFrame:
    """``id`` and ``gaps``: numbers between a conversation's first and last turn that no row has; 0 without numbers."""
    turn = F.col(turn_column)
    return turns.groupBy(F.col(id_column).alias("id")).agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"))


SUMMARY = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summaries(parts: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``: the sums of its blocks, its whole audit, and the SHA-256 of the repaired rows
    as ``role:text``, newline-joined.

    A conversation of one block is digested in its row.  The digest of a longer one is a chain by definition: its blocks pass
    in order through one task, one block in memory at a time.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    alone = parts.where("alone").select("id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    schema = T.StructType([parts.schema["id"], *T._parse_datatype_string(SUMMARY).fields])
    id_type = _arrow_type(parts.schema["id"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed():
            types = [id_type, *[pa.int64()] * 5, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                [key, *sums, "".join(audits), digest.hexdigest()], types)], [f.name for f in schema.fields])
        key, begun, sums, audits, digest, first = None, False, [], [], None, True
        for id_, *numbers, audit, turns in _stretches(batches):
            if not begun or id_ != key:
                if begun:
                    yield closed()
                key, begun, sums, audits, digest, first = id_, True, [0] * 5, [], hashlib.sha256(), True
            sums = [a + b for a, b in zip(sums, numbers)]
            audits.append(audit)
            for turn in turns:
                digest.update((("" if first else "\n") + turn["role"] + ":" + turn["text"]).encode("utf-8", "surrogatepass"))
                first = False
        if begun:
            yield closed()
    rest = parts.where("not alone").repartition("id").sortWithinPartitions("id", "part", "block").select(
        "id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns").mapInArrow(work, schema)
    return alone.unionByName(rest)
