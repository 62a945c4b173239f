"""Embedding near-duplicates: binary codes of randomly rotated vectors find pairs, bounds decide which are computed exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import components, is_small

SEED = 42
BITS = 256
BAND = 12
CONFIDENCE = 4.0
BLOCK = 1024
SMALL = 64
#: Bits of a rotated value where it meets another vector's code: 16 levels between a vector's least and greatest value.
LEVELS = 4
PAIRS = 16384


@dataclass(frozen=True)
class Settings:
    """``bits``: code length (vectors are filled up with zeros to at least so many dimensions before they are rotated).
    ``band``: bits of a meeting key; each code has ``bits // band`` keys.  A pair at angle t is missed with
    probability (1 - (1 - t / pi) ** band) ** (bits // band): 3 % at a cosine of 0.9, under 0.1 % from 0.95.  Raise
    ``band`` by one and ``bits`` by a third for each doubling of the vectors, to keep keys small and recall high.
    ``confidence``: width of the bounds of an estimate; 4 misses about one pair in 10,000 that is at the threshold.
    ``block``: vectors of a key that are compared at once; greater keys are cut into pairs of blocks."""
    threshold: float = 0.9
    bits: int = BITS
    band: int = BAND
    confidence: float = CONFIDENCE
    block: int = BLOCK
    seed: int = SEED


def rotation(dimensions: int, settings: Settings) -> np.ndarray:
    """The first rows of a random rotation of ``max(bits, dimensions)`` dimensions: what a vector of fewer meets of it."""
    size = max(settings.bits, dimensions)
    q, r = np.linalg.qr(np.random.default_rng(settings.seed).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:dimensions]


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their signs (+1, -1) and the correction factors <sign / sqrt(n), rotated vector>."""
    turned = units @ turn
    signs = np.where(turned >= 0, 1.0, -1.0)
    return turned, signs, (turned * signs).sum(1) / np.sqrt(turned.shape[1])


def errors(factor: np.ndarray, bits: int, settings: Settings) -> np.ndarray:
    """Bounds of the estimate <code, other> / factor, which is unbiased: confidence * sqrt((1 - factor^2) / factor^2 / (n - 1))."""
    return settings.confidence * np.sqrt(np.maximum(0.0, 1 - factor ** 2) / factor ** 2 / max(1, bits - 1))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; the scale is taken out first, so that no square overflows."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _valid(vector: Column) -> Column:
    low = F.array_min(F.transform(vector, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0).otherwise(1)))
    return F.coalesce((low == 1) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, filled up with zeros."""
    packed = np.packbits(bits, axis=1)
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    out[:, :packed.shape[1]] = packed
    return out.view(np.uint64)


def pack(turned: np.ndarray, signs: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is stored of each vector: the words of its signs and of its values in ``LEVELS`` bit planes (rows, 1 + LEVELS, words),
    the least value and the step between two levels.  Values are rounded up or down by one fixed random threshold a
    dimension, so that they are right on average and the same wherever the vector is encoded."""
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / ((1 << LEVELS) - 1), 1e-12)
    edge = np.random.default_rng(settings.seed + 1).random(turned.shape[1])
    level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + edge), 0, (1 << LEVELS) - 1).astype(np.uint8)
    return np.stack([_words(signs > 0), *(_words(level >> j & 1) for j in range(LEVELS))], axis=1), low, step


def band_keys(words: np.ndarray, settings: Settings, bits: int) -> np.ndarray:
    """The meeting keys of sign words: the number of the band before its bits."""
    bands = bits // settings.band
    signs = np.unpackbits(words.view(np.uint8), axis=1)[:, :bands * settings.band]
    return signs.reshape(len(words), bands, settings.band) @ (1 << np.arange(settings.band)) + (np.arange(bands) << settings.band)


CODE = "keys array<bigint>, code binary, factor double, low double, step double"


def _codes(settings: Settings):
    """Rotates and encodes every vector, once."""
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, code, values = [None] * len(batch), [None] * len(batch), np.zeros((3, len(batch)))
            sizes = batch.map(len).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                turn = turns.setdefault(int(size), rotation(int(size), settings))
                turned, signs, factor = encode(unit(np.stack(batch.iloc[at].to_numpy())), turn)
                words, low, step = pack(turned, signs, settings)
                values[:, at] = factor, low, step
                for i, key, word in zip(at, band_keys(np.ascontiguousarray(words[:, 0]), settings, turned.shape[1]), words):
                    keys[i], code[i] = key, word.tobytes()
            yield pd.DataFrame({"keys": keys, "code": code, "factor": values[0], "low": values[1], "step": values[2]})
    return F.pandas_udf(codes, CODE)


@dataclass(frozen=True)
class Codes:
    """Stored codes of some vectors of one length, ready to be compared."""
    bits: int
    words: np.ndarray
    factor: np.ndarray
    low: np.ndarray
    step: np.ndarray

    @classmethod
    def of(cls, frame: pd.DataFrame, settings: Settings) -> "Codes":
        bits = max(settings.bits, int(frame["dims"].iloc[0]))
        words = np.frombuffer(b"".join(frame["code"]), np.uint64).reshape(len(frame), 1 + LEVELS, -1)
        return cls(bits, words, *(frame[c].to_numpy(np.float64) for c in ("factor", "low", "step")))

    def upper(self, x: np.ndarray, y: np.ndarray, settings: Settings) -> np.ndarray:
        """Upper bounds of the cosines of x and y, from the signs of x and the levels of y: products are counted bits."""
        weights = 1 << np.arange(LEVELS)
        counts = lambda words: np.bitwise_count(words).sum(-1, dtype=np.int64)
        own, levels = self.words[x, 0], self.words[y, 1:]
        product = self.low[y] * (2 * counts(own) - self.bits) + self.step[y] * (2 * (counts(own[:, None] & levels) @ weights) - counts(levels) @ weights)
        rounding = settings.confidence * self.step[y] / 2 / self.factor[x]
        return product / (np.sqrt(self.bits) * self.factor[x]) + np.hypot(errors(self.factor[x], self.bits, settings), rounding)


def _candidates(groups: np.ndarray, codes: Codes, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group (``groups``: where they begin, and the end) whose cosine may reach the threshold by both codes.

    Small groups are paired row by row at equal distances, all groups at once; large ones a few rows at a time."""
    begins, sizes = groups[:-1], np.diff(groups)
    group = np.repeat(np.arange(len(sizes)), sizes)
    small = np.flatnonzero(sizes[group] <= SMALL)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def kept(a: np.ndarray, b: np.ndarray) -> None:
        for begin in range(0, len(a), PAIRS):
            x, y = a[begin:begin + PAIRS], b[begin:begin + PAIRS]
            for one, other in ((0, 1), (1, 0)):
                near = codes.upper((x, y)[one], (x, y)[other], settings) >= settings.threshold
                x, y = x[near], y[near]
            found.append((x, y))
    for apart in range(1, min(SMALL, int(sizes.max(initial=0)))):
        small = small[small + apart < len(group)]
        small = small[group[np.minimum(small + apart, len(group) - 1)] == group[small]]
        kept(small, small + apart)
    for g in np.flatnonzero(sizes > SMALL):
        rows = np.arange(begins[g], begins[g] + sizes[g])
        for begin in range(0, len(rows), 16):
            x, y = np.nonzero(np.arange(begin, min(begin + 16, len(rows)))[:, None] < np.arange(len(rows)))
            kept(rows[x + begin], rows[y])
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(2))


def _near(frame: pd.DataFrame, groups: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Rows of whole groups -> pairs of rows that the codes leave, each at the first of its bands."""
    codes = Codes.of(frame, settings)
    a, b = _candidates(groups, codes, settings)
    own, mixed = frame["own"].to_numpy(), (frame["bi"] != frame["bj"]).to_numpy()
    apart = ~mixed[a] | (own[a] != own[b])   # two blocks that meet: only pairs across them
    a, b = a[apart], b[apart]
    keys, band = band_keys(np.ascontiguousarray(codes.words[:, 0]), settings, codes.bits), frame["key"].to_numpy() >> settings.band
    ahead, good = np.arange(keys.shape[1]), np.ones(len(a), bool)
    for begin in range(0, len(a), PAIRS):
        x, y = a[begin:begin + PAIRS], b[begin:begin + PAIRS]
        good[begin:begin + PAIRS] = ~((keys[x] == keys[y]) & (ahead < band[x][:, None])).any(1)
    return a[good], b[good]


def _exact(frame: pd.DataFrame, a: np.ndarray, b: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The pairs at the threshold or above, in double precision."""
    units = unit(np.stack(frame["embedding"].to_numpy()))
    good = np.ones(len(a), bool)
    for begin in range(0, len(a), PAIRS):
        x, y = a[begin:begin + PAIRS], b[begin:begin + PAIRS]
        good[begin:begin + PAIRS] = np.einsum("ij,ij->i", units[x], units[y]) >= settings.threshold
    return a[good], b[good]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node) with the components of the given ones: labels fall to the least until they rest."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


PLACE = ["dims", "key", "bi", "bj", "own", "id"]


def _wanted(frame: pd.DataFrame, groups: np.ndarray, settings: Settings) -> Iterator[pd.DataFrame]:
    """The rows that are in a pair that the codes leave: only their vectors are brought."""
    a, b = _near(frame, groups, settings)
    if len(a):
        yield frame.iloc[np.unique(np.r_[a, b])][PLACE]


def _linked(frame: pd.DataFrame, groups: np.ndarray, settings: Settings) -> Iterator[pd.DataFrame]:
    """What links add to each vector's partners, and edges of a spanning forest."""
    a, b = _exact(frame, *_near(frame, groups, settings), settings)
    if not len(a):
        return
    ids, place = np.unique(frame["id"].to_numpy(), return_inverse=True)
    sizes = frame["size"].to_numpy(np.float64)
    partners = (np.bincount(place[a], sizes[b], len(ids)) + np.bincount(place[b], sizes[a], len(ids))).astype(np.int64)
    seen = np.flatnonzero(partners)
    node, least = _forest(place[a], place[b], len(ids))
    yield pd.DataFrame({"id": np.r_[ids[seen], ids[node]], "partners": np.r_[partners[seen], np.zeros(len(node), np.int64)],
                        "other": pd.array([None] * len(seen) + ids[least].tolist(), "Int64")})[["id", "other", "partners"]]


def _blocks(work, settings: Settings):
    """Rows sorted by (dims, key, bi, bj) -> what ``work`` makes of whole groups of vectors of one length."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(frame: pd.DataFrame, groups: np.ndarray) -> Iterator[pd.DataFrame]:
            dims = frame["dims"].to_numpy()[groups[:-1]]
            for size in np.unique(dims):
                at = np.flatnonzero(dims == size)   # they follow each other, as rows are sorted by it
                begin, end = groups[at[0]], groups[at[-1] + 1]
                yield from work(frame.iloc[begin:end], np.append(groups[at], end) - begin, settings)

        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            marks = batch[["dims", "key", "bi", "bj"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(1)])
            if len(starts) > 1:
                yield from done(batch, starts)
            rest = batch.iloc[starts[-1]:]
        if rest is not None and len(rest):
            yield from done(rest, np.array([0, len(rest)]))
    return run


def find_near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
                         settings: Settings = Settings()) -> DataFrame:
    """One row per vector: ``id``, ``n_links`` (other vectors at the threshold or above), ``component`` (smallest id reachable).

    Equal vectors are one node that counts as many.  Every vector is rotated and encoded once.  Nodes meet on bands of their sign
    codes; only stored codes travel to the bands, where estimates by counted bits and their bounds leave the pairs to
    compute exactly.  The vectors of those alone are then brought, in double precision, and only pairs at
    the threshold link.  Keys are cut into blocks, and a task returns rows, partner counts and edges of a spanning forest,
    never pairs.  A pair that meets at several bands counts at the first.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own component; so
    are rows with a null id (component null).  Vectors of different lengths never link.  Rows that share
    an id but not the vector count as separate vectors and as one node of the components.
    An empty table gives an empty one.  Other columns are not read.
    """
    kind = dict(vectors.select(F.col(vector_column).alias("v")).dtypes)["v"]
    rows = vectors.select(F.col(id_column).alias("id"),
                          F.col(vector_column).cast(kind if kind == "array<float>" else "array<double>").alias("embedding"))
    valid = F.col("id").isNotNull() & _valid(F.col("embedding"))
    rows = rows.select("id", F.when(valid, F.col("embedding")).alias("embedding"))
    rows = rows.select("id", "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    nodes = rows.where("embedding is not null").groupBy("k1", "k2").agg(
        F.min("id").alias("id"), F.count("*").alias("size"), F.first("embedding").alias("embedding"))
    nodes = checkpointed(nodes.select("k1", "k2", F.monotonically_increasing_id().alias("node"), "id", "size", "embedding",
                                      F.size("embedding").alias("dims"), _codes(settings)("embedding").alias("c")))

    keyed = nodes.select("node", "dims", F.explode("c.keys").alias("key"))
    crowded = keyed.groupBy("dims", "key").agg(F.count("*").alias("count")).where(F.col("count") > settings.block).select(
        "dims", "key", F.ceil(F.col("count") / settings.block).cast("int").alias("blocks"))
    crowded = checkpointed(crowded)
    code = ["c.code", "c.factor", "c.low", "c.step"]
    meeting = nodes.select(F.col("node").alias("id"), "dims", F.explode("c.keys").alias("key"), *code).join(
        F.broadcast(crowded) if is_small(crowded, 24) else crowded, ["dims", "key"], "left")
    own = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
    meeting = meeting.select("*", own.alias("own")).select(
        "*", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("with"))
    meeting = meeting.select("dims", "key", F.least("own", "with").alias("bi"), F.greatest("own", "with").alias("bj"), "own",
                             "id", "code", "factor", "low", "step")
    block = ["dims", "key", "bi", "bj"]
    wanted = checkpointed(meeting.repartition(*block).sortWithinPartitions(*block).mapInPandas(
        _blocks(_wanted, settings), "dims int, key long, bi int, bj int, own int, id long"))
    brought = wanted.join(nodes.select(F.col("node").alias("id"), "size", "embedding", *code), "id")
    met = brought.repartition(*block).sortWithinPartitions(*block).mapInPandas(_blocks(_linked, settings), "id long, other long, partners long")
    met = checkpointed(met.where("other is null or id <> other").groupBy("id", "other").agg(F.sum("partners").alias("partners")))
    degrees = checkpointed(met.where("other is null").select(F.col("id").alias("node"), "partners"))
    edges = met.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    labels = components(edges)
    shared = nodes.groupBy("id").agg(F.count("*").alias("count")).where("count > 1")   # one id, several vectors
    if not shared.isEmpty():
        same_id = nodes.join(shared, "id").groupBy("id").agg(F.min("node").alias("b"))
        edges = edges.union(nodes.join(same_id, "id").where("node <> b").select("node", "b"))
        labels = components(edges)
    labelled = checkpointed(nodes.select("node", "k1", "k2", "id", "size").join(labels, "node", "left").join(
        degrees, "node", "left").select("k1", "k2", "id", F.coalesce("component", "node").alias("component"),
                                        (F.coalesce("partners", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    least = checkpointed(labelled.groupBy("component").agg(F.min("id").alias("least")))
    named = checkpointed(labelled.join(least, "component").select("k1", "k2", "n_links", "least"))
    linked = rows.where("embedding is not null").select("id", "k1", "k2").join(named, ["k1", "k2"]).select(
        "id", "n_links", F.col("least").alias("component"))
    return linked.union(rows.where("embedding is null").select("id", F.lit(0).cast("long"), "id"))
