"""Approximate nearest neighbours by cosine: an inverted multi-index.

Unit vectors are cut into two halves, and each half is quantised by centroids of its own. A pair of
centroids is a cell, so that few centroids make many cells. A query takes its centroids in each half by
distance and walks the pairs of them with a heap, least sum of (squared) distances first; the entries of
the cells it comes to are reranked by their exact cosine. It walks twice:

* to ``FIRST`` entries: the k-th best of them bounds what may still enter the result;
* onward from there. A cell is passed over if by the triangle inequality, in both halves, no vector of it
  reaches the bound, which loses nothing; the walk ends when ``visit`` of all entries were come to (at
  least ``LEAST``). That share is what makes the search approximate: with vectors that are spread evenly in
  64 dimensions, 0.45 finds about 0.95 of the neighbours; in clustered data the bound ends most walks early.

The centroids come from a sample of about ``SAMPLE`` vectors by hash; every vector is an entry.
Of equal vectors only the smallest ids can be a neighbour, so that copies, however many, become k + 1 ids,
cut on the map side. Cells are dealt to shards of about ``SHARD`` entries, larger cells to several, and a
query goes to a shard once, with the cells it looks for; a task holds one shard and ``QUERIES`` queries at
most. The driver holds the centroids and the sizes of the cells: a number of rows that parameters bound.

The score is the cosine of the vectors as given, in double precision. Vectors that are null or zero, hold a
null or non-finite component, or have no id take no part; missing components of shorter vectors count as
zero. A repeated id is a row of its own as a candidate, one query (of its vector that is least by its bytes) and never its own
hit. Only the id and the vector are read, so that other columns may have any name. An empty table, or one
without a query, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, prepared, stored
from .vectors import best, matrix, packed, sound, unpacked

CENTROIDS, SAMPLE, ROUNDS = 64, 16384, 12
FIRST, VISIT, LEAST = 256, 0.45, 4096
SHARD, QUERIES, _STRIP = 2048, 2048, 64
_SLACK = 1e-9

_PLACED = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary()), ("cell", pa.int32()), ("gap_a", pa.float64()),
                     ("gap_b", pa.float64())])
_PLACED_DDL = "vec_id long, vector binary, cell int, gap_a double, gap_b double"
_PROBES_DDL = "query_id long, vector binary, shard int, cells binary"
_HITS = "query_id long, vec_id long, score double"


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the vectors, their lengths) as doubles; very large or small ones are scaled first, which no cosine shows."""
    v = vectors.astype(float)
    most = np.abs(v).max(axis=1, initial=0)
    odd = (most > 1e100) | (most < 1e-100) & (most > 0)
    v[odd] /= most[odd, None]
    return v, np.sqrt((v * v).sum(axis=1))


def square_gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points ** 2).sum(axis=1)[:, None] + (centres ** 2).sum(axis=1) - 2 * points @ centres.T, 0)


def centroids(points: np.ndarray, wanted: int) -> np.ndarray:
    """k-means: distinct starting points, then ``ROUNDS`` rounds."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(5).permutation(len(distinct))[:wanted]]
    for _ in range(ROUNDS):
        owner = square_gaps(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, points)
        n = np.bincount(owner, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def walk(near_a: np.ndarray, near_b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centroids by the sum of their distances. A pair is pushed by the two that come before it."""
    order_a, order_b = np.argsort(near_a, kind="stable").tolist(), np.argsort(near_b, kind="stable").tolist()
    a, b = [float(near_a[i]) for i in order_a], [float(near_b[i]) for i in order_b]
    done = [0] * len(a)  # how many pairs of this first centroid have been taken
    heap = [(a[0] + b[0], 0, 0)]
    while heap:
        _, i, j = heappop(heap)
        yield order_a[i], order_b[j]
        done[i] = j + 1
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and done[i + 1] == j:
            heappush(heap, (a[i + 1] + b[j], i + 1, j))


class _Index:
    """What a task needs to walk: centroids, sizes of the cells, their radii and their shards."""

    def __init__(self, a: np.ndarray, b: np.ndarray, dtype: str, dimension: int):
        self.a, self.b, self.dtype, self.dimension = a, b, dtype, dimension

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.a.shape[1]
        return square_gaps(unit[:, :half], self.a), square_gaps(unit[:, half:], self.b)

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            given = matrix(x.column(1), self.dimension)
            v, length = units(given)
            held = np.flatnonzero(length > 0)
            a, b = self.halves(v[held] / length[held, None])
            i, j = a.argmin(axis=1), b.argmin(axis=1)
            yield batch(_PLACED, [x.column(0).take(pa.array(held)), packed(given[held]),
                                  pa.array(i * len(self.b) + j, pa.int32()),
                                  *(np.sqrt(g[np.arange(len(held)), c]) for g, c in ((a, i), (b, j)))])

    def sized(self, counts: dict[int, int], radius_a: dict[int, float], radius_b: dict[int, float]) -> _Index:
        """Sizes and shards: neighbouring cells share one, a cell of more than SHARD entries has several."""
        self.size = np.zeros(len(self.a) * len(self.b), dtype=np.int64)
        self.size[list(counts)] = list(counts.values())
        self.radius = [np.array([r.get(i, 0.0) for i in range(len(c))]) for r, c in ((radius_a, self.a), (radius_b, self.b))]
        self.shard, self.parts = np.zeros(len(self.size), dtype=np.int64), np.ones(len(self.size), dtype=np.int64)
        shard, room = -1, 0
        for cell in np.flatnonzero(self.size):
            n = int(self.size[cell])
            if n > SHARD:
                self.parts[cell] = -(-n // SHARD)
                self.shard[cell], shard, room = shard + 1, shard + int(self.parts[cell]), 0
                continue
            if n > room:
                shard, room = shard + 1, SHARD
            self.shard[cell] = shard
            room -= n
        self.entries = int(self.size.sum())
        return self

    def cells(self, a: np.ndarray, b: np.ndarray, reach: float | None, visit: float) -> np.ndarray:
        """Cells that a query comes to; without a reach the first ones, with it those after them."""
        done, found = 0, []
        first, most = min(FIRST, self.entries), max(LEAST, int(visit * self.entries))
        if reach is not None:  # what is ruled out in both halves together
            least = [np.maximum(np.sqrt(g) - r, 0) ** 2 for g, r in zip((a, b), self.radius)]
        for i, j in walk(a, b):
            cell = i * len(self.b) + j
            n = int(self.size[cell])
            if not n:
                continue
            if reach is None:
                found.append(cell)
            elif done >= first and least[0][i] + least[1][j] <= reach:
                found.append(cell)
            elif done >= first:
                continue
            done += n
            if done >= (first if reach is None else most):
                break
        return np.array(found, dtype=np.int64)

    def probes(self, visit: float, onward: bool):
        """A row for each query and shard, with the cells that are looked for there."""
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                v, length = units(unpacked(f["vector"], self.dtype, self.dimension))
                a, b = self.halves(v / length[:, None])
                rows = []
                for q, (own, vector) in enumerate(zip(f["query_id"], f["vector"])):
                    reach = None
                    if onward:  # |q - x|^2 = 2 - 2 cosine
                        floor = f["floor"].iloc[q]
                        reach = np.inf if pd.isna(floor) else 2 - 2 * floor + _SLACK
                    cells = self.cells(a[q], b[q], reach, visit)
                    cells = np.sort(cells)
                    shards = self.shard[cells]
                    for at in np.split(np.arange(len(cells)), np.flatnonzero(np.diff(shards)) + 1) if len(cells) else []:
                        held = cells[at].astype(np.int32).tobytes()
                        rows += [(own, vector, int(s), held) for s in range(
                            shards[at[0]], shards[at[0]] + int(self.parts[cells[at[0]]]))]
                yield pd.DataFrame(rows, columns=["query_id", "vector", "shard", "cells"])
        return run

    def rerank(self, k: int):
        """The k nearest entries of each query in the cells it looks for, within a shard."""
        def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"})]
            if len(entries) and len(queries):
                entries = entries.sort_values("vec_id")
                ids = entries["vec_id"].to_numpy()
                v, length = units(unpacked(entries["vector"], self.dtype, self.dimension))
                unit = v / length[:, None]
                cells, cell = np.unique(entries["cell"].to_numpy(), return_inverse=True)
            for at in range(0, len(queries) if len(entries) else 0, _STRIP):
                strip = queries.iloc[at:at + _STRIP]
                own = strip["query_id"].to_numpy()
                q, q_length = units(unpacked(strip["vector"], self.dtype, self.dimension))
                asked = np.stack([np.isin(cells, np.frombuffer(c, dtype=np.int32)) for c in strip["cells"]])
                near = np.where(asked[:, cell] & (ids != own[:, None]), (q / q_length[:, None]) @ unit.T, -np.inf)
                # What rounding may have put in another order is scored again, pair by pair.
                edge = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None] \
                    if near.shape[1] > k else np.full((len(near), 1), -np.inf)
                row, column = np.nonzero((near >= edge - _SLACK) & (near > -np.inf))
                exact = np.full(near.shape, -np.inf)
                for low in range(0, len(row), 8192):
                    r, c = row[low:low + 8192], column[low:low + 8192]
                    exact[r, c] = (q[r] * v[c]).sum(axis=1) / (q_length[r] * length[c])
                row, column = best(exact, k)
                out.append(pd.DataFrame({"query_id": own[row], "vec_id": ids[column], "score": exact[row, column]}))
            return pd.concat(out)
        return run


def nearest(vectors: DataFrame, id_: str, vector: str, is_query: Column, k: int = 5, n_centroids: int = CENTROIDS,
            visit: float = VISIT) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``is_query`` names, a condition on ``vec_id``."""
    spark = prepared(vectors.sparkSession)
    given = vectors.where(F.col(id_).isNotNull() & sound(vector) & F.exists(vector, lambda x: x != 0)).select(
        F.col(id_).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    kind = given.schema["v"].dataType.elementType.typeName()
    dtype = "<f4" if kind == "float" else "<f8"
    given = given.withColumn("v", F.col("v").cast("array<float>" if kind == "float" else "array<double>"))
    total = given.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n, dimension = total["n"], max(total["d"] or 0, 2)
    share = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    sample = given.where(share).select("v").toArrow()["v"].combine_chunks()
    points, length = units(matrix(sample, dimension)) if len(sample) else (np.zeros((1, dimension)), np.ones(1))
    points, half = points / length[:, None], dimension // 2
    wanted = min(n_centroids, max(1, n // 32))
    index = _Index(centroids(points[:, :half], wanted), centroids(points[:, half:], wanted), dtype, dimension)

    def placed(rows: DataFrame) -> DataFrame:
        return rows.select("vec_id", "v").mapInArrow(index.place, _PLACED_DDL)

    # Of equal vectors: k + 1 ids, one of which may be the query's own, and k rows of each.
    copies, rows_of_id = Window.partitionBy("vector").orderBy("vec_id"), Window.partitionBy("vector", "vec_id").orderBy("cell")
    entries = stored(placed(given).withColumn("place", F.dense_rank().over(copies)).where(F.col("place") <= k + 1)
                     .withColumn("place", F.row_number().over(rows_of_id)).where(F.col("place") <= k).drop("place"),
                     "multi-index-entries")
    cells = entries.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap_a").alias("a"), F.max("gap_b").alias("b")).collect()
    radii: tuple[dict, dict] = {}, {}
    for r in cells:  # as many as there are pairs of centroids, at most
        for held, at, gap in zip(radii, divmod(r["cell"], len(index.b)), (r["a"], r["b"])):
            held[at] = max(held.get(at, 0.0), gap)
    index.sized({r["cell"]: r["n"] for r in cells}, *radii)
    where = spark.createDataFrame([(r["cell"], int(index.shard[r["cell"]]), int(index.parts[r["cell"]])) for r in cells],
                                  "cell int, shard int, parts int")
    dealt = entries.select("vec_id", "vector", "cell").join(F.broadcast(where), "cell").withColumn(
        "shard", (F.col("shard") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")).drop("parts")

    queries = stored(placed(given.where(is_query)).groupBy(
        F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector")), "multi-index-queries")
    blocks = max(1, -(-queries.count() // QUERIES))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    shards = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def hits(probes: DataFrame) -> DataFrame:
        return shards.groupBy("shard", "block").cogroup(probes.withColumn("block", block).groupBy(
            "shard", "block")).applyInPandas(index.rerank(k), _HITS)

    def first_k(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = stored(first_k(hits(queries.mapInPandas(index.probes(visit, False), _PROBES_DDL))).drop("rank"),
                  "multi-index-first")
    floors = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).select(
        "query_id", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    onward = queries.join(floors, "query_id", "left").mapInPandas(index.probes(visit, True), _PROBES_DDL)
    return first_k(near.union(hits(onward))).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
