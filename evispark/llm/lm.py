"""Language-model scores: masked pseudo-likelihood of a window network that sees both sides of a token."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from math import prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from ..session import shared_folder
from .common import word_blocks, written


@dataclass(frozen=True)
class Settings:
    """The ``classes ** 2 - shared`` most frequent words of the corpus are tokens of their own, the others share ``shared``
    tokens by their hash.  The network sees ``span`` tokens on each side through ``width`` hidden units and predicts a
    token's class (its rank's block of ``classes``, 255 at most), then the token within the class.
    Each of the ``rounds`` of training masks another fold of the tokens of all documents; together they mask every token once.
    Words that share a token are told apart by their own counts (``word_counts``).  Texts are cut once into blocks of whole
    documents; a block is full at ``block`` words or ``distinct`` different ones."""
    classes: int = 32
    shared: int = 32
    span: int = 2
    width: int = 16
    rounds: int = 2
    rate: float = 0.15
    batch: int = 2048
    chunks: int = 64
    seed: int = 42
    block: int = 1 << 20
    distinct: int = 1 << 18

    @property
    def tokens(self) -> int:
        return self.classes * self.classes


def shapes(s: Settings) -> list[tuple[int, ...]]:
    """Of the context tables (one per place, with a row for "beyond the text"), the hidden bias, and the two output layers."""
    return [(2 * s.span, s.tokens + 1, s.width), (s.width,), (s.width, s.classes), (s.classes,), (s.classes, s.width, s.classes),
            (s.classes, s.classes)]


def split(flat: np.ndarray, s: Settings) -> list[np.ndarray]:
    """The network's arrays as views of one vector."""
    out, at = [], 0
    for shape in shapes(s):
        size = prod(shape)
        out.append(flat[at:at + size].reshape(shape))
        at += size
    return out


def initial(s: Settings) -> np.ndarray:
    return (np.random.default_rng(s.seed).standard_normal(sum(prod(x) for x in shapes(s))) * 0.1).astype(np.float32)


def cut(docs: DataFrame, s: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Whole texts as blocks of word numbers, written once: the only pass over text.

    ``block``, ``ids`` and ``sizes`` (words) of its documents, ``codes`` (every word's place among the block's different words),
    ``words`` (64-bit hashes of these, A-Z in lower case) and ``counts`` (how often each stands there)."""
    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, sizes, codes, seen = TaskContext.get().partitionId() << 33, 0, [], [], [], numbered()

        def full() -> pa.RecordBatch:
            row = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
            words = np.fromiter(map(xxh64_intdigest, seen), np.uint64, len(seen)).view(np.int64)
            lists = [pa.concat_arrays(ids), pa.array(sizes, pa.int32()), pa.array(words), pa.array(np.bincount(row, minlength=len(seen)))]
            ids_, sizes_, words_, counts_ = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)
            return pa.RecordBatch.from_arrays([pa.array([number]), ids_, sizes_, pa.array([packed(row)]), words_, counts_],
                                              ["block", "ids", "sizes", "codes", "words", "counts"])
        for batch in batches:
            own = batch.column("id")
            for i, text in enumerate(batch.column("text")):
                data, size = (text.as_py() or "").encode("utf-8", "surrogatepass").lower(), 0   # bytes: only A-Z change
                for part in word_blocks(data):
                    codes.append(np.fromiter(map(seen.__getitem__, part), np.uint32, len(part)))
                    size += len(part)
                ids.append(own.slice(i, 1))
                sizes.append(size)
                held += size
                if held >= s.block or len(seen) >= s.distinct or len(sizes) >= s.distinct:
                    yield full()
                    number, held, ids, sizes, codes, seen = number + 1, 0, [], [], [], numbered()
        if ids:
            yield full()

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(texts.schema["id"].dataType)),
                           T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("codes", T.BinaryType()),
                           T.StructField("words", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    path = f"{shared_folder(docs.sparkSession)}/blocks-{uuid.uuid4().hex}"
    # rows are large: look at the size of a row group after each
    texts.mapInArrow(cutting, schema).write.options(**{
        "compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1",
        "parquet.page.size.row.check.min": "1"}).parquet(path)
    return docs.sparkSession.read.parquet(path)


def numbered() -> defaultdict:
    """Gives each new key the next number."""
    return defaultdict(count().__next__)


def packed(codes: np.ndarray) -> bytes:
    """Low halves, then high halves, which are nearly all zero."""
    return codes.astype("<u4").view("<u2").reshape(-1, 2).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    low, high = np.frombuffer(data, "<u2").reshape(2, -1)
    return low.astype(np.int64) | high.astype(np.int64) << 16


def word_counts(blocks: DataFrame) -> DataFrame:
    """How often all documents have each word: ``word`` (hash), ``n``; a table that grows with the corpus."""
    each = blocks.select(F.inline(F.arrays_zip("words", "counts"))).toDF("word", "n")
    return written(each.groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(counts: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """The words that are tokens of their own, the most frequent first; at most ``classes ** 2 - shared``."""
    top = counts.orderBy(F.desc("n"), "word").limit(s.tokens - s.shared).collect()
    return np.array([r["word"] for r in top], np.int64)


def tokens_of(words: np.ndarray, vocab: np.ndarray, s: Settings) -> np.ndarray:
    """Token of each word (hash)."""
    token = (s.tokens - s.shared + words % s.shared).astype(np.uint16)
    if len(vocab):
        order = np.argsort(vocab)
        at = order[np.minimum(np.searchsorted(vocab, words, sorter=order), len(vocab) - 1)]
        token = np.where(vocab[at] == words, at, token).astype(np.uint16)
    return token


def contexts(row: np.ndarray, sizes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the documents in a row, and the tokens on both sides of each; nothing is seen across an end."""
    sizes = np.asarray(sizes, np.int64)
    own = np.arange(len(row)) + np.repeat(np.arange(1, len(sizes) + 1) * s.span, sizes)
    wide = np.full(len(row) + (len(sizes) + 1) * s.span, s.tokens, np.uint16)
    wide[own] = row
    around = np.empty((len(row), 2 * s.span), np.uint16)
    for k, place in enumerate(p for p in range(-s.span, s.span + 1) if p):
        around[:, k] = wide[own + place]
    return np.asarray(row, np.uint16), around


def _hidden(around: np.ndarray, net: list[np.ndarray]) -> np.ndarray:
    total = np.repeat(net[1][None, :], len(around), 0)
    part = np.empty_like(total)
    for k in range(around.shape[1]):
        total += net[0][k].take(around[:, k], 0, part, "clip")   # all tokens are below the table's length
    return np.tanh(total, out=total)


def _by_class(tokens: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the tokens by class, the classes that occur and where each begins in that order."""
    group = (tokens // s.classes).astype(np.uint8)
    sizes = np.bincount(group, minlength=s.classes)
    present = np.flatnonzero(sizes)
    return np.argsort(group, kind="stable"), present, (np.cumsum(sizes) - sizes)[present]


def _inner(h: np.ndarray, net: list[np.ndarray], present: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of rows by class: the scores of the tokens within their class."""
    out = np.empty((len(h), net[5].shape[1]), h.dtype)
    for c, begin, end in _parts(present, starts, len(h)):
        np.matmul(h[begin:end], net[4][c], out=out[begin:end])
        out[begin:end] += net[5][c]
    return out


def _parts(present: np.ndarray, starts: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """Each class with the place where its rows begin and end."""
    begins = starts.tolist()
    return zip(present.tolist(), begins, [*begins[1:], n])


def _places(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of one value of each row in the flat array."""
    return np.arange(0, x.size, x.shape[1]) + at


def _highest(x: np.ndarray) -> np.ndarray:
    """The greatest value of each row, by columns: rows are short and many."""
    return np.ascontiguousarray(x.T).max(0)[:, None]


def _log_of(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each row at one place."""
    x -= _highest(x)
    chosen = x.reshape(-1)[_places(x, at)].astype(np.float64)
    return chosen - np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= _highest(x)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]   # a product is several times as fast as a sum of short rows
    return x


def log_probabilities(tokens: np.ndarray, around: np.ndarray, flat: np.ndarray, s: Settings) -> np.ndarray:
    """Of each token, given the tokens on both sides."""
    net, out = split(flat, s), np.empty(len(tokens))
    for begin in range(0, len(tokens), 4 * s.batch):
        part = tokens[begin:begin + 4 * s.batch]
        order, present, starts = _by_class(part, s)
        own, h = part[order], _hidden(around[begin + order], net)
        out[begin + order] = _log_of(h @ net[2] + net[3], own // s.classes) + _log_of(_inner(h, net, present, starts), own % s.classes)
    return out


def train_step(tokens: np.ndarray, around: np.ndarray, flat: np.ndarray, squares: np.ndarray, s: Settings) -> None:
    """One AdaGrad step on a batch of masked tokens, in place."""
    net, past, m = split(flat, s), split(squares, s), len(tokens)
    order, present, starts = _by_class(tokens, s)
    tokens, around = tokens[order], around[order]
    h = _hidden(around, net)

    def move(values: np.ndarray, sums: np.ndarray, gradient: np.ndarray, at=...) -> None:
        total = gradient * gradient
        total += sums[at]
        sums[at] = total
        total += 1e-6
        gradient *= s.rate
        gradient /= np.sqrt(total, out=total)
        values[at] -= gradient
    outer = _softmax(h @ net[2] + net[3])
    outer.reshape(-1)[_places(outer, tokens // s.classes)] -= 1
    p = _softmax(_inner(h, net, present, starts))
    p.reshape(-1)[_places(p, tokens % s.classes)] -= 1
    back, inner = outer @ net[2].T, np.empty((len(present), s.width, s.classes), flat.dtype)
    for k, (c, begin, end) in enumerate(_parts(present, starts, m)):
        back[begin:end] += p[begin:end] @ net[4][c].T
        np.matmul(h[begin:end].T, p[begin:end], out=inner[k])
    move(net[4], past[4], inner / m, present)
    move(net[5], past[5], np.add.reduceat(p, starts, axis=0) / m, present)
    move(net[2], past[2], h.T @ outer / m)
    move(net[3], past[3], outer.sum(0) / m)
    back *= (1 - h * h) / m
    move(net[1], past[1], back.sum(0))
    for k in range(around.shape[1]):
        order = np.argsort(around[:, k], kind="stable")   # 16 bits: by radix
        ids = around[order, k]
        begins = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
        move(net[0][k], past[0][k], np.add.reduceat(back[order], begins, axis=0), ids[begins])


def fold(row: np.ndarray, sizes: np.ndarray, turn: int, s: Settings) -> np.ndarray:
    """Places, over the documents' tokens in a row, that a round masks: every ``rounds``-th of each document, wherever it is."""
    sizes = np.asarray(sizes, np.int64)
    ends = np.cumsum(sizes)
    sums = np.diff(np.r_[0, np.cumsum(row, dtype=np.int64)][np.r_[0, ends]])
    return np.flatnonzero((np.arange(len(row)) + np.repeat(sums - ends + sizes, sizes)) % s.rounds == turn)


def _train_round(blocks: DataFrame, vocab: np.ndarray, flat: np.ndarray, s: Settings, turn: int) -> np.ndarray:
    """Every task trains its own copy on all its blocks; the copies are averaged by their masked tokens, in chunks
    that Spark brings together, each a running sum of fixed size."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, squares, weight = flat.copy(), np.zeros_like(flat), 0
        for block in _rows(batches):
            row, sizes = tokens_of(block["words"], vocab, s)[block["codes"]], block["sizes"]
            tokens, around = contexts(row, sizes, s)
            at = np.random.default_rng([s.seed, turn, block["block"]]).permutation(fold(row, sizes, turn, s))
            for begin in range(0, len(at), s.batch):
                part = at[begin:begin + s.batch]
                train_step(tokens[part], around[part], own, squares, s)
            weight += len(at)
        if weight:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(s.chunks), pa.int32()), "weight": [float(weight)] * s.chunks,
                                              "part": [x.tobytes() for x in np.array_split(own, s.chunks)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, tuple[float, np.ndarray]] = {}
        for batch in batches:
            for chunk, weight, part in zip(batch["chunk"], batch["weight"], batch["part"]):
                total, vector = sums.get(chunk, (0.0, 0.0))
                sums[chunk] = total + weight, vector + weight * np.frombuffer(part, np.float32).astype(np.float64)
        yield pd.DataFrame({"chunk": list(sums), "part": [(v / t).astype(np.float32).tobytes() for t, v in sums.values()]})

    learned = blocks.select("block", "sizes", "codes", "words").mapInArrow(learn, "chunk int, weight double, part binary")
    rows = learned.repartition("chunk").mapInPandas(add, "chunk int, part binary").collect()   # the size of one network
    if not rows:
        return flat
    return np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(rows, key=lambda r: r["chunk"])])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks one at a time: lists of numbers as arrays, word numbers unpacked, ids as they are."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            read = {"block": lambda x: x.as_py(), "codes": lambda x: unpacked(x.as_buffer()), "sizes": lambda x: x.values.to_numpy(),
                    "words": lambda x: x.values.to_numpy(), "ids": lambda x: x.values, "found": lambda x: x.values}
            yield {name: read[name](value) for name, value in row.items()}


def train(blocks: DataFrame, counts: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary and network of all documents (``blocks`` of ``cut``, ``counts`` of ``word_counts``)."""
    vocab, flat = vocabulary(counts, s), initial(s)
    for turn in range(s.rounds):
        flat = _train_round(blocks, vocab, flat, s, turn)
    return vocab, flat


def _known(blocks: DataFrame, counts: DataFrame, vocab: np.ndarray, s: Settings) -> DataFrame:
    """``block``, ``found``: of each of its words the place, the token and, if it shares the token, the log-probability within.
    Every word counts half a time more than it was seen, and so do all unseen ones together."""
    spark = blocks.sparkSession
    own = F.broadcast(spark.createDataFrame([(int(w), k) for k, w in enumerate(vocab)], "word long, own int"))   # below classes ** 2 rows
    common = F.lit(s.tokens - s.shared) + F.pmod("word", F.lit(s.shared)).cast("int")
    total = F.broadcast(counts.join(own, "word", "left_anti").groupBy(common.alias("shared")).agg(
        (F.sum("n") + (F.count(F.lit(1)) + 1) / 2).alias("all")))   # at most ``shared`` rows
    each = blocks.select("block", F.posexplode("words").alias("at", "word")).join(counts, "word", "left").join(own, "word", "left")
    each = each.withColumn("shared", F.when(F.col("own").isNull(), common)).join(total, "shared", "left")
    log = F.log((F.coalesce("n", F.lit(0)) + 0.5) / F.coalesce("all", F.lit(0.5)))
    within = F.when(F.col("own").isNull(), log).otherwise(F.lit(0.0)).cast("float")
    return each.groupBy("block").agg(F.collect_list(F.struct("at", F.coalesce("own", "shared").alias("token"), within.alias("within"))).alias("found"))


def score_rows(row: np.ndarray, sizes: np.ndarray, flat: np.ndarray, s: Settings, within: np.ndarray | float = 0.0) -> pd.DataFrame:
    """Scores of the documents whose tokens stand in a row."""
    each, full = log_probabilities(*contexts(row, sizes, s), flat, s) + within, np.flatnonzero(sizes)
    total = np.zeros(len(sizes))
    if len(full):
        total[full] = np.add.reduceat(each, np.r_[0, np.cumsum(sizes[full])[:-1]])
    mean = pd.Series(np.round(total / np.maximum(sizes, 1), 6)).where(sizes > 0)
    return pd.DataFrame({"n_tokens": sizes.astype(np.int64), "log_prob": np.round(total, 4), "score": mean})


def score(blocks: DataFrame, model: tuple[np.ndarray, np.ndarray], s: Settings = Settings(), counts: DataFrame | None = None) -> DataFrame:
    """One row per document of the blocks (of ``cut``): ``id``, ``n_tokens``, ``log_prob`` (sum of each token's log-probability
    given both sides), ``score`` (their mean; higher is more like the corpus).

    Null, empty and blank texts have no tokens, a sum of zero and a null score; repeated rows and null ids are
    scored each on their own; an empty table gives an empty one.  Other columns are not read.  The network depends
    on how the rows were cut into blocks, as its copies are trained apart and averaged; the blocks are written, so a task that
    runs again does the same.  With ``counts`` (of ``word_counts``) a word that shares a token also counts by its probability
    among the words of that token.
    """
    vocab, flat = model
    schema = T.StructType([T.StructField("id", blocks.schema["ids"].dataType.elementType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("log_prob", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _rows(batches):
            codes, within = block["codes"], 0.0
            if "words" in block:
                token = tokens_of(block["words"], vocab, s)
            else:
                found = block["found"]
                size = 0 if found is None else len(found)
                token, logs = np.zeros(size, np.uint16), np.zeros(size)
                if size:
                    at = found.field("at").to_numpy()
                    token[at], logs[at] = found.field("token").to_numpy(), found.field("within").to_numpy()
                within = logs[codes]
            out = score_rows(token[codes], block["sizes"], flat, s, within)
            yield pa.RecordBatch.from_arrays([block["ids"]] + [pa.Array.from_pandas(out[c]) for c in out], ["id", *out])

    if counts is None:
        return blocks.select("ids", "sizes", "codes", "words").mapInArrow(scored, schema)
    known = _known(blocks, counts, vocab, s)
    return blocks.select("block", "ids", "sizes", "codes").join(known, "block", "left").select("ids", "sizes", "codes", "found").mapInArrow(scored, schema)
