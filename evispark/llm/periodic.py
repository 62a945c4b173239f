"""Periodic runs of words: a harmonic grid names places, difference-cover extensions measure them.

A run of period q that is at least 2q words long holds two neighbouring multiples of q, k*q and (k+1)*q, which are
equal words; how far they agree to both sides gives the whole run.  Over all q these grids have n + n/2 + n/3 + ...
places.  The agreement of two places is a longest common extension: few words are compared until both places are in
the difference cover, and from there the least common prefix between two sorted sampled suffixes tells the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORTEST = 12
#: A perfect difference set: every difference modulo 31 occurs exactly once, so any two places reach the cover together.
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Texts are looked at together up to so many words, and so many places of the grid are measured at once.
BATCH_WORDS, BATCH_PLACES = 1 << 18, 1 << 19
# Fixed: with so many of the words behind or before a place equal, a run of SHORTEST words can't be missed.
NEAR = 3


def _meeting() -> np.ndarray:
    """By two remainders: the fewest steps that bring both into the cover."""
    inside = np.zeros(MODULUS, bool)
    inside[list(COVER)] = True
    steps = np.full((MODULUS, MODULUS), -1)
    at = np.arange(MODULUS)
    for d in range(MODULUS):
        both = inside[(at[:, None] + d) % MODULUS] & inside[(at[None, :] + d) % MODULUS]
        steps[both & (steps < 0)] = d
    return steps


class Extensions:
    """Longest common extensions to the right of any two places of a sequence of numbers."""

    def __init__(self, codes: np.ndarray):
        self.codes, n = codes, len(codes)
        at = np.arange(n)
        self.steps = _meeting()
        sampled = at[np.isin(at % MODULUS, COVER)]
        self.index = np.full(n + 1, -1)
        self.index[sampled] = np.arange(len(sampled))
        blocks = sliding_window_view(np.append(codes + 1, np.zeros(MODULUS, codes.dtype)).astype(">u4"), MODULUS)[sampled]
        rank = np.unique(np.ascontiguousarray(blocks).view(f"V{4 * MODULUS}").ravel(), return_inverse=True)[1].ravel()
        levels, step = [rank], MODULUS
        while len(sampled) and rank.max() + 1 < len(sampled):   # equal blocks are told apart by twice as many words
            after = self.index[np.minimum(sampled + step, n)]
            rank = np.unique(rank * (len(sampled) + 1) + np.where(after >= 0, rank[after] + 1, 0), return_inverse=True)[1].ravel()
            levels.append(rank)
            step *= 2
        self.rank = rank
        order = np.argsort(rank)
        self.least = [self._neighbours(sampled[order[:-1]], sampled[order[1:]], levels)]
        width = 1
        while 2 * width <= len(self.least[0]):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _neighbours(self, x: np.ndarray, y: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of suffixes that are sorted next to each other: block ranks from long to short, then words."""
        n, far = len(self.codes), np.zeros(len(x), np.int64)
        for t in range(len(levels) - 1, -1, -1):
            a, b = self.index[np.minimum(x + far, n)], self.index[np.minimum(y + far, n)]
            far += np.where((a >= 0) & (b >= 0) & (levels[t][a] == levels[t][b]), MODULUS << t, 0)
        return far + self._compared(x + far, y + far, np.full(len(x), MODULUS))

    def _compared(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from two places on, at most so many."""
        n, far = len(self.codes), np.zeros(len(x), np.int64)
        going = np.flatnonzero((most > 0) & (np.maximum(x, y) < n))
        while len(going):
            a, b = x[going] + far[going], y[going] + far[going]
            going = going[self.codes[a] == self.codes[b]]
            far[going] += 1
            going = going[(far[going] < most[going]) & (np.maximum(x[going], y[going]) + far[going] < n)]
        return far

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words agree from ``x`` and from ``y`` on (different places)."""
        n, need = len(self.codes), self.steps[x % MODULUS, y % MODULUS]
        far = self._compared(x, y, need)
        met = np.flatnonzero((far == need) & (np.maximum(x, y) + need < n))
        a, b = self.rank[self.index[x[met] + need[met]]], self.rank[self.index[y[met] + need[met]]]
        low, wide = np.minimum(a, b), np.abs(a - b)
        level = np.frexp(wide.astype(np.float64))[1] - 1
        rest = np.zeros(len(met), np.int64)
        for t in np.unique(level):
            here = np.flatnonzero(level == t)
            table = self.least[t]
            rest[here] = np.minimum(table[low[here]], table[low[here] + wide[here] - (1 << int(t))])
        far[met] += rest
        return far


def _places(codes: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid places and periods where the words near by agree too, some at a time.

    A run of 12 words or more has 6 agreeing places at least, so 3 of the 5 others lie to one side of the grid place.
    """
    n = len(codes)
    fence = np.concatenate([np.full(NEAR, -1, codes.dtype), codes, np.full(NEAR, -2, codes.dtype)])
    at, period, held = [], [], 0
    for q in range(1, longest // 2 + 1):
        i = np.flatnonzero(codes[:n - q:q] == codes[q::q]) * q
        if not len(i):
            continue
        before = after = True
        for k in range(1, NEAR + 1):
            after = after & (fence[np.minimum(i + NEAR + k, n + NEAR)] == fence[np.minimum(i + q + NEAR + k, n + NEAR + 1)])
            before = before & (fence[i + NEAR - k] == fence[i + q + NEAR - k])
        i = i[after | before]
        if len(i):
            at.append(i)
            period.append(np.full(len(i), q))
            held += len(i)
        if held > BATCH_PLACES:
            yield np.concatenate(at), np.concatenate(period)
            at, period, held = [], [], 0
    if held:
        yield np.concatenate(at), np.concatenate(period)


def runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Per text (word numbers from 0 on) its runs: rows (start, length, period) by start, then period.

    Texts stand behind each other, each with a number of its own behind it, so that no run leaves its text.
    """
    found = [np.zeros((0, 3), np.int64) for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(texts) or sizes.max() < SHORTEST:
        return found
    top = max(int(t.max()) for t in texts if len(t)) + 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes = np.empty(int((sizes + 1).sum()), np.int64)
    for k, t in enumerate(texts):
        codes[starts[k]:starts[k] + len(t)] = t
        codes[starts[k] + len(t)] = top + k
    hit = np.zeros(len(texts), bool)
    places = _places(codes, int(sizes.max()))
    first = next(places, None)
    if first is None:
        return found
    # Extensions are prepared for texts that have a place only; a text of prose has none.
    batches = [first, *places] if len(texts) > 1 else None
    if batches is not None:
        for i, _ in batches:
            hit[np.searchsorted(starts, i, "right") - 1] = True
        if not hit.all():
            chosen = np.flatnonzero(hit)
            for k, rows in zip(chosen, runs([texts[k] for k in chosen])):
                found[k] = rows
            return found
    ahead, back = Extensions(codes), Extensions(codes[::-1].copy())
    n, kept = len(codes), np.zeros((0, 3), np.int64)
    for i, q in batches if batches is not None else _chained(first, places):
        left = back.common(n - i, n - i - q)
        start, end = i - left, i + q + ahead.common(i, i + q)
        long = end - start >= np.maximum(SHORTEST, 2 * q)
        kept = np.concatenate([kept, np.stack([start, end, q], 1)[long]])
        kept = kept[np.lexsort(kept.T[::-1])]          # of one stretch the least period comes first
        kept = kept[np.append(True, (kept[1:, :2] != kept[:-1, :2]).any(1))] if len(kept) else kept
    owner = np.searchsorted(starts, kept[:, 0], "right") - 1
    rows = np.stack([kept[:, 0] - starts[owner], kept[:, 1] - kept[:, 0], kept[:, 2]], 1)
    order = np.lexsort((rows[:, 2], rows[:, 0], owner))
    rows, owner = rows[order], owner[order]
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [rows[ends[k]:ends[k + 1]] for k in range(len(texts))]


def _chained(first, rest):
    yield first
    yield from rest


def repeated(n: int, rows: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run behind its first period."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, rows[:, 0] + rows[:, 2], 1)
    np.add.at(marks, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(marks[:-1]) > 0


def _groups(sizes: list[int]) -> Iterator[list[int]]:
    """Texts to look at together: of like lengths, so that few periods are tried in vain; a long one by itself."""
    group, held = [], 0
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        if group and held + sizes[k] > BATCH_WORDS:
            yield group
            group, held = [], 0
        group.append(k)
        held += sizes[k]
    if group:
        yield group


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document ``id``, ``n_words``, ``runs`` (array of start, length, period; by start, then period) and ``collapsed``,
    its words without those that repeat the first period of a run, joined by one space.

    Words are what white space (x20, x09-x0D) parts.  A run has its least period q, ``max(12, 2 q)`` words at least, and can't
    be made longer; equal runs don't occur, so there are no ties.  Null and empty texts have no words and no runs; ids may be
    null or occur again (each row is judged for itself); an empty table gives no rows; other columns are not read.  A text of
    any length is looked at whole, in memory of some hundred bytes per word of its own; short texts are looked at together.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
            out: list = [None] * len(split)
            for group in _groups([len(w) for w in split]):
                numbers: dict[bytes, int] = {}
                texts = [np.array([numbers.setdefault(w, len(numbers)) for w in split[g]], np.int64) for g in group]
                for g, rows in zip(group, runs(texts)):
                    out[g] = rows
            collapsed = []
            for w, rows in zip(split, out):
                if len(rows):
                    gone = repeated(len(w), rows)
                    w = [x for x, g in zip(w, gone.tolist()) if not g]
                collapsed.append(b" ".join(w).decode("utf-8", "surrogatepass"))
            sizes = np.array([len(r) for r in out], np.int32)
            rows = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(rows[:, i]) for i in range(3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(w) for w in split], pa.int64()), listed, pa.array(collapsed, pa.string())],
                ["id", "n_words", "runs", "collapsed"])

    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(judge, schema)
