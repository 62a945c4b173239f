"""Top-k cosine search of a table of queries over a table of chunks.

Two exact plans give the same rows:

* ``top_k`` with a query side of proven size: the query matrix is broadcast and
  every task scans its chunks once, in Arrow batches, keeping k rows per query.
  Only those leave the task.
* beyond that size, ``top_k_grid``: chunks go to cells around pivots, a query
  visits the cells that could still hold one of its k best (triangle inequality
  on angles), and hot cells are split into bounded blocks of chunks and queries.

``approximate_top_k`` runs the same block kernel over random-hyperplane buckets.
Ranks are by score rounded to ``DIGITS``, then chunk id, so they do not depend on
the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from .sizes import dealt, fits, join_checked

DIGITS = 6
MAX_QUERY_VALUES = 8_000_000     # 64 MB of doubles: the most a query broadcast may hold
QUERY_SLICE = 512                # queries scored at a time inside a task
TILE = 1024                      # chunks that meet them at a time
HELD_VALUES = 4_000_000          # 32 MB of doubles: the chunks a task holds at a time
PROBES = 4096                    # rows of queries and their cells sent at a time
BLOCK = 20_000                   # most rows of either side in one grid block


@dataclass(frozen=True)
class Names:
    query_id: str = "query_id"
    query_vec: str = "embedding"
    chunk_id: str = "chunk_id"
    chunk_vec: str = "embedding"


def _unit(values: pd.Series) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero and so score 0."""
    if len(values) == 0:
        return np.zeros((0, 0))
    m = np.asarray(np.stack(values.to_numpy()), dtype=np.float64)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _first(q: np.ndarray, place: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which rows are the k best of their query, in order."""
    order = np.lexsort((place, -score, q))
    ordered = q[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered, "left") < k]


def _places(ids: np.ndarray) -> np.ndarray:
    """The order of the ids as numbers, null last."""
    codes, _ = pd.factorize(ids, sort=True)
    return np.where(codes < 0, len(ids), codes)


def _score(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, min_score: float | None,
           mask: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query row, chunk row and score of the k best chunks for each query row (ties at the edge resolved by id).

    A slice of queries meets a tile of chunks at a time, and what can't be among the k best any more is left out, so memory
    grows neither with the queries nor with the chunks.
    """
    if len(q) == 0 or len(c) == 0:
        return
    place, floor = _places(ids), -1.5 if min_score is None else min_score
    rows = np.argsort(place, kind="stable")   # by id, so that of equal scores the earlier tile's stay
    c, place = c[rows], place[rows]
    if mask is not None:
        mask = mask[0][:, rows], mask[1]
    for lo in range(0, len(q), QUERY_SLICE):
        part = q[lo:lo + QUERY_SLICE]
        edge, full = np.full(len(part), floor), np.zeros(len(part), bool)
        qi, ci, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(c), TILE):
            s = part @ c[at:at + TILE].T
            if mask is not None:
                s[~mask[0][:, at:at + TILE][mask[1][lo:lo + QUERY_SLICE]]] = -np.inf
            if at == 0 and s.shape[1] > k:
                edge = np.maximum(edge, np.round(np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k], DIGITS))
            tq, tc = np.nonzero(s >= edge[:, None] - 10.0 ** -DIGITS)
            found = np.round(s[tq, tc], DIGITS) + 0.0
            keep = (found > edge[tq]) | (found == edge[tq]) & ~full[tq]
            qi, ci, score = np.append(qi, tq[keep]), np.append(ci, tc[keep] + at), np.append(score, found[keep])
            best = _first(qi, place[ci], score, k)
            qi, ci, score = qi[best], ci[best], score[best]
            full = np.bincount(qi, minlength=len(part)) >= k
            edge[full] = score[np.searchsorted(qi, np.flatnonzero(full), "right") - 1]
        yield qi + lo, rows[ci], score


def _held(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
    """Vectors of length one and the other columns, as many rows at a time as a task may hold."""
    units, rest, values = [], [], 0
    for batch in batches:
        batch = batch[batch["vec"].notna()]   # here, as a filter in the plan would compute each vector twice
        if len(batch):
            units.append(_unit(batch["vec"]))
            rest.append(batch.drop(columns="vec"))
            values += units[-1].size
        if values >= HELD_VALUES:
            yield np.concatenate(units), pd.concat(rest, ignore_index=True)
            units, rest, values = [], [], 0
    if units:
        yield np.concatenate(units), pd.concat(rest, ignore_index=True)


def _routes(routes: pd.DataFrame | None) -> tuple[list, np.ndarray] | None:
    """The distinct routes (True: urgent only; a cancer; None: all) and the route number of every query."""
    if routes is None:
        return None
    urgent = routes["urgent_only"].fillna(False).to_numpy(dtype=bool)
    cancer = routes["cancer"].fillna("").astype(str).str.lower().to_numpy()
    numbers, distinct = pd.factorize(np.where(urgent, "urgent", np.char.add("of ", cancer.astype(str))))
    return [True if d == "urgent" else d[3:] or None for d in distinct], numbers


def _route_mask(routes: tuple[list, np.ndarray] | None, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Which chunks of the batch each distinct route sees, and the route number of every query."""
    if routes is None or not routes[0]:
        return None
    urgent = batch["is_urgent"].fillna(False).to_numpy(dtype=bool)
    cancers = batch["cancer_types"].fillna("").str.lower()
    masks = [urgent if key is True else np.ones(len(batch), dtype=bool) if key is None
             else cancers.str.contains(key, regex=False).to_numpy(dtype=bool) for key in routes[0]]
    return np.stack(masks), routes[1]


def rank_hits(candidates: DataFrame, k: int, query_id: str = "query_id", chunk_id: str = "chunk_id") -> DataFrame:
    """Ranked rows per query; ``rank <= k`` lets Spark cut to k before the shuffle."""
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), chunk_id)
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _asked(queries: DataFrame, names: Names, routed: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """The queries, the distinct searches among them (``query_number``, vec and route), and the columns that tell searches apart."""
    columns = [F.col(names.query_id).alias("query_id"), F.col(names.query_vec).alias("vec")]
    if routed:
        columns += [F.coalesce("urgent_only", F.lit(False)).alias("urgent_only"), F.coalesce("cancer", F.lit("")).alias("cancer")]
    # Written once: measuring and reading must not embed the queries again.
    q = checkpointed(queries.select(*columns)).where(F.col("vec").isNotNull())
    search = ["vec", *(["urgent_only", "cancer"] if routed else [])]
    return q, checkpointed(q.select(*search).distinct().withColumn("query_number", F.monotonically_increasing_id())), search


def _answers(q: DataFrame, once: DataFrame, search: list[str], hits: DataFrame, k: int, carry: Sequence[str]) -> DataFrame:
    """The ranked hits of each query: those of the search that it shares with all queries like it."""
    number = join_checked(q, once, search).select("query_id", "query_number")
    return rank_hits(number.join(hits, "query_number"), k).select("query_id", "rank", "chunk_id", "score", *carry)


def top_k(queries: DataFrame, chunks: DataFrame, k: int = 5, where: Column | None = None,
          min_score: float | None = None, names: Names = Names(), routed: bool = False,
          carry: Sequence[str] = (), max_query_values: int = MAX_QUERY_VALUES) -> DataFrame:
    """``(query_id, rank, chunk_id, score, *carry)`` of the k nearest chunks.

    ``where`` filters chunks before the search and reaches the scan.  With
    ``routed``, each query's ``urgent_only`` and ``cancer`` columns choose its chunks.
    Queries of the same vector and route are searched once.  The searches are counted
    before they are broadcast; if they do not fit, those of ``top_k_grid`` run instead.
    """
    if where is not None:
        chunks = chunks.where(where)
    q, once, search = _asked(queries, names, routed)
    head = once.select(F.size("vec").alias("d")).first()
    dim = max(1, head["d"]) if head else 1
    # The count needs the numbers only and stops at the limit.
    if not fits(once.select("query_number"), max_query_values // dim):
        return _answers(q, once, search, _grid(once, chunks, k, min_score, names, routed, carry), k, carry)
    side = once.toArrow().to_pandas()   # bounded by the check above
    matrix, numbers = _unit(side["vec"]), side["query_number"].to_numpy()
    routes = _routes(side[["urgent_only", "cancer"]] if routed else None)
    shared = queries.sparkSession.sparkContext.broadcast((matrix, numbers, routes))

    extra = list(dict.fromkeys([*carry, *(["is_urgent", "cancer_types"] if routed else [])]))
    scan = chunks.select(F.col(names.chunk_id).alias("id"), F.col(names.chunk_vec).alias("vec"), *extra)
    schema = T.StructType([
        T.StructField("query_number", T.LongType()), T.StructField("chunk_id", scan.schema["id"].dataType),
        T.StructField("score", T.DoubleType()), *[scan.schema[c] for c in carry]])

    def scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, numbers, r = shared.value
        for units, rows in _held(batches):
            ids = rows["id"].to_numpy()
            for qi, ci, score in _score(m, units, ids, k, min_score, _route_mask(r, rows)):
                yield pd.DataFrame({"query_number": numbers[qi], "chunk_id": ids[ci], "score": score, **{c: rows[c].to_numpy()[ci] for c in carry}})

    # A task emits k rows per search and holding, and ``rank_hits`` cuts each task's rows to k before the shuffle.
    candidates = dealt(scan).mapInPandas(scan_batches, schema)
    return _answers(q, once, search, rank_hits(candidates, k, "query_number").drop("rank"), k, carry)


def _blocks(queries: DataFrame, chunks: DataFrame, cell: Sequence[str], block: int,
            chunk_counts: DataFrame | None, query_id: str) -> tuple[DataFrame, DataFrame]:
    """Split both sides of every cell into bounded blocks; each pair of blocks meets once.

    Chunks of a cell are spread over ``_nc`` blocks and copied to each of the cell's
    ``_nq`` query blocks, and the other way round.  Counts per cell are one narrow row.
    """
    cell = list(cell)
    if chunk_counts is None:
        chunk_counts = chunks.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    nc = chunk_counts.select(*cell, F.ceil(F.col("n") / block).cast("int").alias("_nc"))
    nq = queries.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nq"))
    sizes = checkpointed(nc.join(nq, cell))   # narrow, and used by both sides
    sizes = F.broadcast(sizes) if fits(sizes) else sizes

    def own(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    c = chunks.join(sizes, cell).withColumn("_cb", own("id", "_nc")).withColumn("_qb", every("_nq"))
    q = queries.join(sizes, cell).withColumn("_qb", own(query_id, "_nq")).withColumn("_cb", every("_nc"))
    return q.drop("_nc", "_nq"), c.drop("_nc", "_nq")


def _meet(queries: DataFrame, chunks: DataFrame, cell: Sequence[str], k: int, min_score: float | None,
          routed: bool, carry: Sequence[str], block: int, chunk_counts: DataFrame | None = None, query_id: str = "query_id") -> DataFrame:
    """Score every pair of blocks; at most k rows per query leave a pair."""
    q, c = _blocks(queries, chunks, cell, block, chunk_counts, query_id)
    keys = [*cell, "_cb", "_qb"]
    schema = T.StructType([
        T.StructField(query_id, queries.schema[query_id].dataType),
        T.StructField("chunk_id", chunks.schema["id"].dataType),
        T.StructField("score", T.DoubleType()), *[chunks.schema[x] for x in carry]])
    carry = list(carry)

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        routes = _routes(left[["urgent_only", "cancer"]] if routed else None)
        numbers, ids, others = left[query_id].to_numpy(), right["id"].to_numpy(), {x: right[x].to_numpy() for x in carry}
        best = [np.concatenate(x) for x in zip(*_score(_unit(left["vec"]), _unit(right["vec"]), ids, k, min_score, _route_mask(routes, right)))]
        return pd.DataFrame({query_id: numbers[best[0]], "chunk_id": ids[best[1]], "score": best[2], **{x: others[x][best[1]] for x in carry}})

    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(pair, schema)


def _chunk_side(chunks: DataFrame, names: Names, routed: bool, carry: Sequence[str]) -> DataFrame:
    extra = list(dict.fromkeys([*carry, *(["is_urgent", "cancer_types"] if routed else [])]))
    # Read several times: written once, so that no vector is computed again.
    return checkpointed(chunks.select(F.col(names.chunk_id).alias("id"), F.col(names.chunk_vec).alias("vec"), *extra)).where(F.col("vec").isNotNull())


def top_k_grid(queries: DataFrame, chunks: DataFrame, k: int = 5, where: Column | None = None,
               min_score: float | None = None, names: Names = Names(), routed: bool = False,
               carry: Sequence[str] = (), pivots: int = 256, seeds: int = 2048, block: int = BLOCK) -> DataFrame:
    """Exact top-k for query tables too large to broadcast.

    A cell is all chunks nearest to one pivot, with the largest angle r among them.
    No chunk of it can be closer to a query than angle(query, pivot) - r.  A sample
    of the chunks gives each query a k-th best score to beat; cells that cannot beat
    it are skipped, all others are searched in full.  Cells go in packs of up to
    ``block`` chunks, so that a query travels once to a pack, not to every cell of it.
    """
    if where is not None:
        chunks = chunks.where(where)
    q, once, search = _asked(queries, names, routed)
    return _answers(q, once, search, _grid(once, chunks, k, min_score, names, routed, carry, pivots, seeds, block), k, carry)


def _packs(counts: Sequence[int], block: int) -> np.ndarray:
    """The pack of each cell, in order: neighbours share one while it has at most ``block`` chunks."""
    packs, held = [], 0
    for n in counts:
        fresh = not packs or held + n > block
        packs.append((packs[-1] + 1 if packs else 0) if fresh else packs[-1])
        held = n if fresh else held + n
    return np.array(packs, np.int64)


def _grid(once: DataFrame, chunks: DataFrame, k: int, min_score: float | None, names: Names, routed: bool, carry: Sequence[str],
          pivots: int = 256, seeds: int = 2048, block: int = BLOCK) -> DataFrame:
    """``query_number``, chunk_id, score and ``carry`` of the k best of each search."""
    c = _chunk_side(chunks, names, routed, carry)
    spark = once.sparkSession
    # A fixed number of rows, picked by hash: bounded whatever the corpus size.
    sample = c.orderBy(F.xxhash64("id"), "id").limit(seeds).toArrow().to_pandas()
    if len(sample) == 0:
        return once.select("query_number", F.lit(None).cast(c.schema["id"].dataType).alias("chunk_id"),
                           F.lit(None).cast("double").alias("score"),
                           *[F.lit(None).cast(c.schema[x].dataType).alias(x) for x in carry]).limit(0)
    centre = _unit(sample["vec"])
    shared = spark.sparkContext.broadcast((centre[:pivots], centre, sample.drop(columns="vec")))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value[0]
        for b in batches:
            if len(b):
                u = _unit(b["vec"])
                cosines = np.clip(u @ p.T, -1.0, 1.0)
                zero = ~u.any(axis=1)
                b["cell"] = np.where(zero, -1, cosines.argmax(axis=1)).astype("int32")
                b["angle"] = np.where(zero, 10.0, np.arccos(cosines.max(axis=1)))
                yield b

    placed = c.mapInPandas(assign, T.StructType([
        *c.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))
    # One pass for radius and size of the cells: at most pivots + 1 rows.
    found = sorted(placed.groupBy("cell").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).collect())
    cells = np.array([r["cell"] for r in found])
    radii = np.array([r["r"] for r in found])
    packs = _packs([r["n"] for r in found], block)
    pack_of = spark.createDataFrame([(r["cell"], int(p)) for r, p in zip(found, packs)], "cell int, pack int")
    counts = spark.createDataFrame([(int(p), int(sum(r["n"] for r, at in zip(found, packs) if at == p))) for p in range(packs[-1] + 1)], "pack int, n long")

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, s, seen = shared.value
        for b in batches:
            if not len(b):
                continue
            u = _unit(b["vec"])
            to_beat = np.full(len(b), -2.0)
            known = _score(u, s, seen["id"].to_numpy(), k, None, _route_mask(_routes(b[["urgent_only", "cancer"]] if routed else None), seen))
            for qi, _, score in known:
                full = np.flatnonzero(np.bincount(qi, minlength=len(b)) >= k)
                to_beat[full] = score[np.searchsorted(qi, full, "right") - 1]
            if min_score is not None:
                to_beat = np.maximum(to_beat, min_score)
            angles = np.arccos(np.clip(u @ p.T, -1.0, 1.0))
            nearest = np.maximum(0.0, angles[:, np.maximum(cells, 0)] - radii[None, :])
            # Rounding of scores and arccos error stay well inside this margin.
            reach = np.cos(np.minimum(nearest, np.pi)) + 1e-5 >= to_beat[:, None]
            reach |= (cells == -1)[None, :] | ~u.any(axis=1)[:, None]
            qi, at = np.nonzero(np.logical_or.reduceat(reach, np.searchsorted(packs, np.arange(packs[-1] + 1)), axis=1))
            for lo in range(0, len(qi), PROBES):
                out = b.iloc[qi[lo:lo + PROBES]].copy()
                out["pack"] = at[lo:lo + PROBES].astype("int32")
                yield out

    # Counted per pack and joined: written once, so the bounds are not worked out twice.
    probes = checkpointed(once.mapInPandas(visit, T.StructType([*once.schema.fields, T.StructField("pack", T.IntegerType())])))
    members = placed.join(F.broadcast(pack_of), "cell").drop("angle", "cell")
    candidates = _meet(probes, members, ["pack"], k, min_score, routed, carry, block, counts, "query_number")
    return rank_hits(candidates, k, "query_number").drop("rank")


def approximate_top_k(queries: DataFrame, chunks: DataFrame, k: int = 5, min_score: float | None = None,
                      names: Names = Names(), bands: int = 8, bits: int = 8, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """Approximate top-k: compare only chunks that share a hyperplane signature in some band.

    ``bits`` is the length of a signature: about log2(chunks / 2000) makes buckets of some 2000 chunks, longer ones are
    faster and find less.  It is never derived from the data.  A bucket that is far larger is split into
    bounded blocks.  A query with fewer than k hits is searched again, exactly.
    """
    q = checkpointed(queries.select(F.col(names.query_id).alias("query_id"), F.col(names.query_vec).alias("vec"))).where(F.col("vec").isNotNull())
    c = _chunk_side(chunks, names, False, ())

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes, weights = None, 1 << np.arange(bits)
        for b in batches:
            if not len(b):
                continue
            u = _unit(b["vec"])
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((u.shape[1], bands * bits))
            sig = ((u @ planes) > 0).reshape(len(b), bands, bits) @ weights
            for band in range(bands):
                out = b.copy()
                out["band"] = np.int32(band)
                out["sig"] = sig[:, band].astype("int64")
                yield out

    def keyed(df: DataFrame) -> DataFrame:
        return df.mapInPandas(signatures, T.StructType([
            *df.schema.fields, T.StructField("band", T.IntegerType()), T.StructField("sig", T.LongType())]))

    found = _meet(keyed(q), keyed(c), ["band", "sig"], k, min_score, False, (), block)
    once = found.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    hits = checkpointed(rank_hits(once, k).select("query_id", "rank", "chunk_id", "score"))
    full = hits.groupBy("query_id").count().where(F.col("count") >= k)
    short = q.join(full.select("query_id"), "query_id", "left_anti")
    exact = top_k(short, c, k, min_score=min_score, names=Names(query_id="query_id", query_vec="vec", chunk_id="id", chunk_vec="vec"))
    return hits.join(short.select("query_id"), "query_id", "left_anti").unionByName(exact)


def filtered_after(queries: DataFrame, chunks: DataFrame, column: str, needle: str, k: int = 5, overfetch: int = 3,
                   min_score: float | None = None, names: Names = Names()) -> DataFrame:
    """Over-fetch, then keep hits whose flat field contains the word: may give fewer than k."""
    hits = top_k(queries, chunks, k * overfetch, min_score=min_score, names=names, carry=[column])
    kept = hits.where(F.contains(F.lower(column), F.lit(needle.lower())))
    return rank_hits(kept.drop("rank"), k).select("query_id", "rank", "chunk_id", "score", column)


def recall_against(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact hits that the approximate run found, over all queries."""
    found = approximate.select("query_id", "chunk_id", F.lit(1).alias("found"))
    return exact.join(found, ["query_id", "chunk_id"], "left").agg(
        F.count(F.lit(1)).alias("exact_hits"), F.sum(F.coalesce("found", F.lit(0))).alias("found_hits"))
