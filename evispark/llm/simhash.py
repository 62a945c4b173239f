"""SimHash near-duplicates: fingerprints meet on indices of nearby Golay codewords, then their bits are compared."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from .common import components, is_small, word_blocks

SEED = 42
SHINGLE = 3
DIFFERENCES = 3
HOT = 2048
# Generator polynomial of the (23, 12, 7) binary Golay code, and its lengths.
GENERATOR, LENGTH, CHECK_BITS = 0b110001110101, 23, 11
#: First bit and width of the segments of a fingerprint; the last is filled up with zeros.
SEGMENTS = [(0, 23), (23, 23), (46, 18)]


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 of all 3-word shingles of a text in A-Z lower case; of all its words if there
    are fewer than three; zero without words."""
    if not text:
        return 0
    ones, total, few = np.zeros(64, np.int64), 0, []
    for w in word_blocks(text.encode("utf-8", "surrogatepass").lower(), SHINGLE):   # bytes: only A-Z change, only ASCII space parts
        few = w
        hashes = [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(w[i:] for i in range(SHINGLE))))]
        if hashes:
            ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            total += len(hashes)
    if not total and few:
        ones, total = np.unpackbits(np.array([xxhash.xxh64_intdigest(b" ".join(few), SEED)], ">u8").view(np.uint8)).astype(np.int64), 1
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    left = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - CHECK_BITS)), left)
    return left


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the only error of weight 3 or less, and all errors of weight 4 or less (filled up with -1).

    The code is perfect: every word is within 3 of exactly one codeword, so each syndrome has one
    such error; one of weight 3 has five errors of weight 4 beside it, and lighter ones have none.
    """
    from itertools import combinations
    errors = [sum(1 << b for b in bits) for weight in range(5) for bits in combinations(range(LENGTH), weight)]
    near, wide = np.full(1 << CHECK_BITS, -1), np.full((1 << CHECK_BITS, 6), -1)
    used = np.zeros(1 << CHECK_BITS, int)
    for error, s in zip(errors, _syndromes(np.array(errors))):
        if near[s] < 0:
            near[s] = error
        wide[s, used[s]] = error
        used[s] += 1
    return near, wide


def golay_keys(prints: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys of each fingerprint as (asking, answering).

    Three or fewer differing bits over three segments leave two segments with at most one each.  If x and y
    differ in one bit of a segment, the codeword nearest to x (within 3) is within 4 of y: it is among the one to six
    codewords y is decoded to.  So x asks for its three pairs of nearest codewords, y answers to all pairs
    of the codewords around it, and every link has a key in common.
    """
    near, wide = tables
    values = prints.astype(np.uint64)
    own, around = [], []
    for first, width in SEGMENTS:
        segment = (values >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
        s = _syndromes(segment)
        own.append((segment ^ near[s]) >> CHECK_BITS)
        around.append(np.where(wide[s] < 0, -1, (segment[:, None] ^ wide[s]) >> CHECK_BITS))
    pairs = [(0, 1), (0, 2), (1, 2)]
    asking = np.stack([(k << 24) | (own[a] << 12) | own[b] for k, (a, b) in enumerate(pairs)], axis=1)
    every = []
    for k, (a, b) in enumerate(pairs):
        both = (k << 24) | (around[a][:, :, None] << 12) | around[b][:, None, :]
        every.append(np.where((around[a][:, :, None] < 0) | (around[b][:, None, :] < 0), -1, both).reshape(len(values), -1))
    answering = [row[row >= 0] for row in np.concatenate(every, axis=1)]
    return asking, answering


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in ("asking", "answering")]))
def _keys(prints: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    tables = golay_tables()
    for batch in prints:
        asking, answering = golay_keys(batch.to_numpy(np.int64).view(np.uint64), tables)
        yield pd.DataFrame({"asking": list(asking), "answering": answering})


def _differ(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def paired(prints: DataFrame, hot: int = HOT, cut: Callable[[DataFrame], DataFrame] = checkpointed) -> tuple[DataFrame, DataFrame | None]:
    """Links ``a``, ``b`` of the fingerprints ``fp`` that meet on Golay keys of at most ``hot`` askers, and the fingerprints at the
    other keys (None: there are no such keys)."""
    keyed = cut(prints.select("fp", _keys("fp").alias("k")).select("fp", "k.asking", "k.answering"))
    asking = keyed.select("fp", F.explode("asking").alias("key"))
    answering = keyed.select(F.col("fp").alias("other"), F.explode("answering").alias("key"))
    heavy, members = cut(asking.groupBy("key").count().where(F.col("count") > hot).select("key")), None
    if not heavy.isEmpty():
        side = F.broadcast(heavy) if is_small(heavy, 16) else heavy
        members = cut(asking.join(side, "key", "left_semi").select("fp").union(answering.join(side, "key", "left_semi").select("other")).distinct())
        asking, answering = asking.join(side, "key", "left_anti"), answering.join(side, "key", "left_anti")
    links = asking.join(answering, (asking["key"] == answering["key"]) & (F.col("fp") != F.col("other"))
                        & (_differ("fp", "other") <= DIFFERENCES)).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    return links, members


def around(prints: DataFrame) -> DataFrame:
    """Every ``fp`` with all words within 2 bits of it; ``close``: within 1.  Two within 3 bits meet at a word within 1 of one and 2 of the other."""
    bits = [0, *(1 << i for i in range(64))]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in sorted({a ^ b for a in bits for b in bits}, key=lambda m: (m.bit_count(), m))]
    at = prints.select("*", F.posexplode(F.expr(f"array({', '.join(f'{m}L' if m != -(1 << 63) else 'bigint(-9223372036854775808)' for m in masks)})")).alias("i", "mask"))
    return at.withColumns({"word": F.col("fp").bitwiseXOR(F.col("mask")), "close": F.col("i") < 65}).drop("i", "mask")


def hot_links(prints: DataFrame) -> DataFrame:
    """Edges that connect all of ``fp`` within 3 bits, without comparing pairs: linear in the fingerprints.

    Every fingerprint goes to all words within 2 bits of it.  Two within 3 bits meet at a word within 1 of one and 2 of
    the other; and whatever is within 2 of a word is within 3 of each fingerprint within 1 of it.
    """
    at = around(prints.select("fp"))
    centre = at.where("close").groupBy("word").agg(F.min("fp").alias("centre"))
    return at.join(checkpointed(centre), "word").where("fp <> centre").select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct()


def find_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: ``id``, ``fp`` (fingerprint as a long), ``component`` (smallest id reachable over links).

    Documents of one fingerprint are one node.  Fingerprints meet on Golay keys and link at 3 or fewer differing
    bits.  Keys that more than ``hot`` fingerprints ask for are not paired; all their members go
    through ``hot_links`` instead, which finds the same components without pairs.

    Null, empty and blank texts have fingerprint zero and link like any other; rows with a null id are
    labelled but never the label, and a component of such rows alone has a null one; repeated rows are
    members like others; an empty table gives an empty one.  Other columns are not read.
    """
    docs = checkpointed(docs.select(F.col(id_column).alias("id"), fingerprints(F.col(text_column)).alias("fp")))
    prints = checkpointed(docs.groupBy("fp").agg(F.min("id").alias("least")))
    links, members = paired(prints, hot)
    crowded = members is not None
    extra = hot_links(members) if crowded else None
    labels = components(links.union(extra) if crowded else links)
    labelled = checkpointed(prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")))
    least = checkpointed(labelled.groupBy("component").agg(F.min("least").alias("least_id")))
    named = checkpointed(labelled.join(least, "component").select(F.col("fp").alias("named_fp"), F.col("least_id").alias("component")))
    return docs.join(named, docs["fp"] == named["named_fp"]).select("id", "fp", "component")
