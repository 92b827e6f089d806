"""Nearest neighbours by largest inner product: query-aware collision counting.

The vectors of a block are projected on Gaussian directions and each projection is kept as a sorted array. A query looks into
the arrays in which its own projection t lies farthest out, as those tell most, within windows [t - R, t + R] round it; a vector
in a window collides. For unit vectors of similarity s the other's projection is normal with mean s * t and variance 1 - s * s,
whatever the data, so the number of collisions that a vector of distance R must reach is known: the expected number, less MARGIN
standard deviations. Vectors that reach it are verified by their exact inner product. Virtual rehashing widens R, on the same
arrays, until k verified ones lie within R.

Inner products become similarities by one more dimension, which fills each vector up to the longest norm of its block; blocks
hold norms of a factor of 2**0.5, so the filling stays small, and a query passes over blocks whose norms can't reach its bound.
Blocks are searched in levels of 1, 7, 56, ... blocks: what a level finds bounds the windows of the next one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import discard, materialize

K = 20
#: Sorted arrays of a block, and how many of them a query looks into.
ARRAYS, LOOKS = 384, 64
#: Standard deviations below the expected collisions: 1.3 misses a tenth of vectors on the border of a window, fewer within.
MARGIN = 1.3
#: First radius, and the factor by which it widens; at 2 all unit vectors are within.
RADIUS, WIDEN = 0.4, 1.2
#: Rows of a block, fewer where vectors are long; queries that one task takes to a block.
BLOCK, BLOCK_ENTRIES, QUERIES = 8192, 1 << 22, 1 << 14
#: Each level has so many times the blocks of all before it.
LEVEL = 8

_at = np.linspace(-8, 8, 8001)
_normal = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in _at])


def normal(x: np.ndarray) -> np.ndarray:
    """Distribution function of the normal distribution, to about 1e-6."""
    return np.interp(x, _at, _normal)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each row's entries added in the same order, so that equal rows have equal ones."""
    return np.add.reduce(x * q, axis=1)


class Block:
    """Sorted arrays of the projections of a block's vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 11):
        self.vectors, (n, d) = vectors, vectors.shape
        self.norms = np.linalg.norm(vectors, axis=1)
        self.longest = float(self.norms.max())
        self.directions = np.random.default_rng([seed, d]).standard_normal((ARRAYS, d + 1))
        unit = np.empty((n, d + 1))
        unit[:, :d] = vectors / self.longest
        unit[:, d] = np.sqrt(np.maximum(0.0, 1 - (self.norms / self.longest) ** 2))
        projected = self.directions @ unit.T
        self.order = np.argsort(projected, axis=1)
        # arrays follow each other in one, each moved beyond the one before, so that one search serves all windows
        self.apart = 4 + 2 * float(np.abs(projected).max())
        sorted_ = np.take_along_axis(projected, self.order, 1)
        self.sorted = (sorted_ + self.apart * np.arange(ARRAYS)[:, None]).ravel()
        self.order = self.order.ravel()

    def collisions(self, arrays: np.ndarray, t: np.ndarray, inner: float, outer: float) -> np.ndarray:
        """For each vector, in how many of the arrays it lies within ``outer`` of t, but not within ``inner``."""
        n, reach = len(self.vectors), self.apart / 2 - 1
        edges = [np.searchsorted(self.sorted, np.clip(t + w, -reach, reach) + self.apart * arrays, side=s) for w, s in ((-outer, "left"), (-inner, "left"), (inner, "right"), (outer, "right"))]
        if inner <= 0:
            edges[1] = edges[2] = edges[3]
        found = [self.order[a:b] for a, b in (*zip(edges[0], edges[1]), *zip(edges[2], edges[3])) if b > a]
        return np.bincount(np.concatenate(found), minlength=n) if found else np.zeros(n, np.int64)

    def search(self, q: np.ndarray, k: int, bound: float, own: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and inner products of the vectors that may be among the ``k`` nearest to ``q`` and reach ``bound``; how many
        were verified. ``own``: the place of the query itself, or -1."""
        none = np.zeros(0, np.int64), np.zeros(0), 0
        size = float(np.linalg.norm(q))
        most = size * self.longest
        if bound > most * (1 + 1e-12):
            return none
        projected = self.directions[:, :-1] @ (q / size)
        arrays = np.argpartition(-np.abs(projected), LOOKS - 1)[:LOOKS]
        t = projected[arrays]
        # the bound's own radius serves at once; without a bound, windows widen until k vectors lie within
        within = lambda score: 2.0 if score == -math.inf else min(2.0, math.sqrt(max(0.0, 2 - 2 * score / most)))
        radius = RADIUS if bound == -math.inf else within(bound)
        n, reached = len(self.vectors), 0.0
        counts, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        open_[own if own >= 0 else n :][:1] = False
        places, scores = [], []
        while True:
            if radius >= 2:
                passed = np.flatnonzero(open_)
            else:
                width = radius + 1e-7
                counts += self.collisions(arrays, t, reached, width)
                s = 1 - radius * radius / 2
                spread = math.sqrt(max(1e-12, 1 - s * s))
                p = normal((t * (1 - s) + width) / spread) - normal((t * (1 - s) - width) / spread)
                least = p.sum() - MARGIN * math.sqrt(float((p * (1 - p)).sum()))
                passed, reached = np.flatnonzero(open_ & (counts >= least)), width
            open_[passed] = False
            places.append(passed)
            scores.append(products(self.vectors[passed], q))
            found = np.concatenate(scores)
            worst = max(bound, np.partition(found, len(found) - k)[len(found) - k] if len(found) >= k else -math.inf)
            if radius >= min(2.0, within(worst)):
                break
            radius = min(radius * WIDEN, within(worst))  # the k best so far lie within: no need to go beyond them
        places, keep = np.concatenate(places), found >= worst
        return places[keep], found[keep], len(found)


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Queries of each block against its vectors, which come before them: rows (dim, slice, block, share, kind, row, id, vector, bound)."""
    key, held, block = None, [], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys = np.stack([table.column(c).to_numpy() for c in ("dim", "slice", "block", "share", "kind")])
        cuts = [0, *(np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            own, (*now, kind) = table.slice(a, b - a), keys[:, a].tolist()
            if now != key:
                key, held, block = now, [], None
            if kind == 0:
                held.append(own.select(["row", "id", "vector"]))
                continue
            if block is None:
                if not held:
                    continue
                data = pa.concat_tables(held).combine_chunks()
                block, held = Block(matrix(data, now[0])), []
                rows = data.column("row").to_numpy()
                by_row = np.argsort(rows)
            vectors, asking, bounds = matrix(own, now[0]), own.column("row").to_numpy(), own.column("bound").fill_null(-math.inf).to_numpy()
            sought, found, scores, tried = [], [], [], 0
            for q, r, bound in zip(vectors, asking.tolist(), bounds.tolist(), strict=True):
                at = int(np.searchsorted(rows, r, sorter=by_row))
                self_at = int(by_row[at]) if at < len(rows) and rows[by_row[at]] == r else -1
                places, values, n = block.search(q, k, bound, self_at)
                tried += n
                if len(places) > k:  # ties beyond k: by id, then by row
                    tied = pa.table({"s": values, "i": data.column("id").take(pa.array(places)), "r": rows[places]})
                    best = tied.sort_by([("s", "descending"), ("i", "ascending"), ("r", "ascending")])
                    where = np.searchsorted(rows, best.column("r").to_numpy()[:k], sorter=by_row)
                    places, values = by_row[where], best.column("s").to_numpy()[:k]
                sought.append(np.full(len(places), r))
                found.append(places)
                scores.append(values)
            found = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sought)), pa.array(rows[found]), data.column("id").take(pa.array(found)).combine_chunks(), pa.array(np.concatenate(scores)), pa.array(np.full(len(found), tried / len(vectors) / len(rows)))], ["query", "row", "id", "score", "tried"])


def matrix(table: pa.Table, d: int) -> np.ndarray:
    return table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def nearest(embeddings: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", tried: list[float] | None = None) -> DataFrame:
    """(query_id, rank, id, score): for each row for which ``is_query`` holds, the ``k`` rows found with the largest inner product,
    nearest first, ties by the smaller id (null last); all other rows, if fewer. A row isn't its own neighbour, but another row of
    the same id, and a copy of its vector, is; each query row has ranks of its own.

    Vectors that are null, empty, all zero or hold a null, NaN or an infinity take no part; vectors meet those of their own length.
    Approximate: nothing is capped, but a vector may fall short of its collisions (see MARGIN). Results don't depend on the order
    of the rows but for equal ids. An empty table gives an empty result; other columns are ignored. ``tried`` gets the largest
    share of a block that its queries verified on average, a level each.
    """
    v = F.col(vector_col)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(math.inf))) & F.exists(v, lambda c: c != 0)
    largest = F.array_max(F.transform(v, lambda c: F.abs(c.cast("double"))))
    norm = F.log2(largest) + F.log2(F.aggregate(v, F.lit(0.0), lambda a, c: a + (c.cast("double") / largest) * (c.cast("double") / largest))) / 2
    kept = embeddings.filter(usable).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), v.alias("vector"), F.size(v).alias("dim"), F.floor(norm * 2 + 0.5).cast("int").alias("slice"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = materialize(kept, "vectors")
    size = F.expr(f"least({BLOCK}, greatest(256, {BLOCK_ENTRIES} div dim))")
    cells = materialize(rows.groupBy("dim", "slice").agg(F.count(F.lit(1)).alias("n")).select("dim", "slice", F.ceil(F.col("n") / size).alias("blocks")), "cells")
    shares = materialize(rows.filter("asks").groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("shares")), "shares")
    most = cells.agg(F.max("blocks")).first()[0] or 0
    tasks = cells.join(shares, "dim").agg(F.sum(F.col("blocks") * F.col("shares"))).first()[0] or 0
    placed = rows.join(F.broadcast(cells), ["dim", "slice"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).join(F.broadcast(shares), "dim")
    asked = rows.filter("asks").drop("slice").join(F.broadcast(shares), "dim").withColumn("share", F.pmod(F.xxhash64(F.lit(1), "row"), F.col("shares")))
    kind = embeddings.schema[id_col].dataType.simpleString()
    array = embeddings.schema[vector_col].dataType.simpleString()
    best = rows.sparkSession.createDataFrame([], f"query long, row long, id {kind}, score double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    first = 0
    while first < most:
        to = max(1, first * LEVEL) - 1
        level = placed.filter(F.col("block").between(first, to))
        data = level.select("dim", "slice", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), "row", "id", F.col("vector").cast(array), F.lit(None).cast("double").alias("bound"))
        bounds = best.groupBy(F.col("query").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
        asking = asked.join(bounds, "row", "left").join(F.broadcast(cells.filter(F.col("blocks") > first)), "dim")
        queries = asking.select("dim", "slice", F.explode(F.sequence(F.lit(first).cast("long"), F.least(F.lit(to).cast("long"), F.col("blocks") - 1))).alias("block"), "share", F.lit(1).alias("kind"), "row", "id", F.col("vector").cast(array), "bound")
        both = data.unionByName(queries).repartition(max(1, min(2 * tasks, 20_000)), "dim", "slice", "block", "share").sortWithinPartitions("dim", "slice", "block", "share", "kind")
        found = materialize(both.mapInArrow(lambda batches: _searched(batches, k), f"query long, row long, id {kind}, score double, tried double"), "found")
        if tried is not None:
            tried.append(found.agg(F.max("tried")).first()[0])
        old, merged = best, best.unionByName(found.drop("tried"))
        best = materialize(merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), "nearest")
        discard(found, old)
        first = to + 1
    names = rows.filter("asks").select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return best.withColumn("rank", F.row_number().over(order)).join(names, "query").select("query_id", "rank", F.col("id").alias(id_col), "score")
