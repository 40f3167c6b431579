"""Exact top-k by inner product: M-trees searched best-first.

Vectors of whole numbers get one more component, so that all have the same length M; then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, and the largest inner product is the smallest distance, which obeys the
triangle inequality. Vectors are dealt to the nearest of a bounded number of pivots (cells, with covering
radii), large cells are cut by a hash of the row, and each part becomes an M-tree: pages with a router, a
covering radius and the distance to the parent's router, stored as rows. A query first searches one
tree of its own cell. The score of its k-th hit then bounds the search elsewhere: cells whose ball lies
beyond it are not visited, and inside a tree pages and entries are passed over by
|d(q, parent) - d(entry, parent)| - radius before any distance to them is computed.

Scores are whole numbers; bounds leave room for rounding and ties are never cut off, so results are
exact. Vectors that are null, or hold a null or non-finite component, take no part; missing components
of shorter vectors count as zero, as an empty vector's do. Null ids take no part. A repeated id is a row
of its own as a candidate, one query (of its smallest vector) and never its own hit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, stored

PAGE, FAN = 64, 16       # entries of a leaf, and children of an inner page
TREE = 4096              # vectors of a tree, about
MOST_PIVOTS = 128
QUERIES = 8192           # queries that meet a tree in one task, about
_SLACK = 1e-6
_STRIP, _PAIRS = 512, 16384  # queries that walk a tree together, distances taken at a time

_VECTORS = "vec_id long, row long, vector binary, norm double, cell int, gap double"
_PAGES = ("cell int, part int, page int, parent int, router binary, radius double, parent_gap double, "
          "ids binary, vectors binary, gaps binary")
_HITS = "query_id long, vec_id long, score long"


def whole_vectors(df: DataFrame, id_: str, vector: str, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(scale * component) of every vector that takes part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(id_).isNotNull() & F.col(vector).isNotNull() & sound).select(
        F.col(id_).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _lifted(vectors: np.ndarray, norm2: float) -> np.ndarray:
    own = (vectors.astype(float) ** 2).sum(axis=1)
    return np.hstack([vectors.astype(float), np.sqrt(np.maximum(norm2 - own, 0))[:, None]])


def _gaps(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=-1))


def build(ids: np.ndarray, vectors: np.ndarray, norm2: float) -> list[tuple]:
    """Pages of an M-tree: (page, parent, router, radius, parent_gap, ids, vectors, gaps)."""
    lifted = _lifted(vectors, norm2)
    pages: list[tuple] = []
    waiting = [(np.arange(len(ids)), -1, None)]
    while waiting:
        members, parent, above = waiting.pop()
        points = lifted[members]
        router = points[_gaps(points, points.mean(axis=0)).argmin()]
        gaps = _gaps(points, router)
        number = len(pages)
        up = float(_gaps(router, above)) if above is not None else 0.0
        leaf = len(members) <= PAGE
        pages.append((number, parent, router.tobytes(), float(gaps.max()), up,
                      *((ids[members].tobytes(), vectors[members].tobytes(), gaps.tobytes()) if leaf else (b"",) * 3)))
        if leaf:
            continue
        seeds = [int(gaps.argmax())]
        nearest = _gaps(points, points[seeds[0]])
        owner = np.zeros(len(members), dtype=int)
        while len(seeds) < FAN and nearest.max() > 0:
            seeds.append(int(nearest.argmax()))
            gap = _gaps(points, points[seeds[-1]])
            owner[gap < nearest] = len(seeds) - 1
            nearest = np.minimum(nearest, gap)
        groups = [members[owner == i] for i in range(len(seeds))]
        if len(seeds) == 1:  # all the same vector
            groups = np.array_split(members, -(-len(members) // PAGE))
        waiting += [(g, number, router) for g in groups if len(g)]
    return pages


class Tree:
    def __init__(self, pages: pd.DataFrame, dimension: int):
        pages = pages.sort_values("page")
        self.routers = np.stack([np.frombuffer(r) for r in pages["router"]])
        self.radius, self.up = pages["radius"].to_numpy(), pages["parent_gap"].to_numpy()
        parents = pages["parent"].to_numpy()
        self.below = np.argsort(parents, kind="stable")       # pages by parent
        number = np.arange(len(pages))
        self.first = np.searchsorted(parents[self.below], number)
        self.children = np.searchsorted(parents[self.below], number, side="right") - self.first
        self.ids = [np.frombuffer(x, dtype=np.int64) for x in pages["ids"]]
        self.vectors = [np.frombuffer(x, dtype=np.int64).reshape(-1, dimension) for x in pages["vectors"]]
        self.gaps = [np.frombuffer(x) for x in pages["gaps"]]

    def _leaves(self, points: np.ndarray, bound: np.ndarray) -> tuple:
        """(query, leaf, distance to its router) that the bounds don't rule out, level by level."""
        query, page = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        found = []
        while len(query):
            gap = np.concatenate([_gaps(points[query[at:at + _PAIRS]], self.routers[page[at:at + _PAIRS]])
                                  for at in range(0, len(query), _PAIRS)])
            keep = gap - self.radius[page] <= bound[query]
            query, page, gap = query[keep], page[keep], gap[keep]
            leaf = self.children[page] == 0
            found.append((query[leaf], page[leaf], gap[leaf]))
            query, page, gap = query[~leaf], page[~leaf], gap[~leaf]
            n = self.children[page]
            child = self.below[np.repeat(self.first[page] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            query, gap = np.repeat(query, n), np.repeat(gap, n)
            near = np.abs(gap - self.up[child]) - self.radius[child] <= bound[query]  # no distance needed yet
            query, page = query[near], child[near]
        return tuple(np.concatenate(x) for x in zip(*found))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, norm2: float, floor: np.ndarray) -> tuple:
        """(query, id, score): the k best of each query, ties to smaller ids.

        Scores below ``floor`` (NaN: none) may be left out. A query reads its leaves best first, in
        waves of 1, 2, 4, ... leaves, and its bound shrinks after each wave; queries that read the same
        leaf do so in one matrix product.
        """
        points = np.hstack([queries.astype(float), np.zeros((len(queries), 1))])
        length2 = (points ** 2).sum(axis=1)
        least_score = np.where(np.isnan(floor), -np.inf, floor)
        exact = norm2 < 2 ** 52  # whole numbers that floating point holds exactly
        left = points[:, :-1] if exact else queries

        def bounds() -> np.ndarray:
            square = np.maximum(length2 + norm2 - 2 * np.where(np.isinf(least_score), 0, least_score), 0)
            return np.where(np.isinf(least_score), np.inf, np.sqrt(square) * (1 + _SLACK) + _SLACK)

        bound = bounds()
        query, page, gap = self._leaves(points, bound)
        least = np.maximum(gap - self.radius[page], 0)
        order = np.lexsort((least, query))
        query, page, gap, least = query[order], page[order], gap[order], least[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = [np.empty(0, np.int64)] * 3
        done, width = 0, 1
        while True:
            open_ = (place >= done) & (least <= bound[query])
            if not open_.any():
                return tuple(best)
            wave = np.flatnonzero(open_ & (place < done + width))
            wave = wave[np.argsort(page[wave], kind="stable")]
            parts = [best]
            for at in np.split(wave, np.flatnonzero(np.diff(page[wave])) + 1) if len(wave) else []:
                leaf, who = page[at[0]], query[at]
                near = np.abs(gap[at, None] - self.gaps[leaf]) <= bound[who, None]
                some = np.flatnonzero(near.any(axis=0))
                if not len(some):
                    continue
                scores = left[who] @ self.vectors[leaf][some].T.astype(left.dtype)
                ids = self.ids[leaf][some]
                r, c = np.nonzero(near[:, some] & (scores >= least_score[who, None]) & (ids != own[who, None]))
                parts.append([who[r], ids[c], scores[r, c].astype(np.int64)])
            best = [np.concatenate(x) for x in zip(*parts)]
            order = np.lexsort((best[1], -best[2], best[0]))
            order = order[np.arange(len(order)) - np.searchsorted(best[0][order], best[0][order]) < k]
            best = [x[order] for x in best]
            last = np.arange(len(order)) - np.searchsorted(best[0], best[0]) == k - 1
            at = best[0][last]
            least_score[at] = np.maximum(least_score[at], best[2][last])
            bound = bounds()
            done, width = done + width, 2 * width


def _search(k: int, norm2: float, dimension: int):
    def run(pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")]
        if len(pages) and len(queries):
            tree = Tree(pages, dimension)
            for at in range(0, len(queries), _STRIP):
                part = queries.iloc[at:at + _STRIP]
                own = part["query_id"].to_numpy()
                vectors = np.stack([np.frombuffer(v, dtype=np.int64) for v in part["vector"]])
                who, ids, scores = tree.search(own, vectors, k, norm2, part["floor"].to_numpy(dtype=float, na_value=np.nan))
                out.append(pd.DataFrame({"query_id": own[who], "vec_id": ids, "score": scores}))
        return pd.concat(out)
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``vectors`` (vec_id, v); queries are its rows by ``is_query``.

    A task holds one tree and one block of queries, so its memory depends on neither table's size.
    """
    prepared(vectors.sparkSession)
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("m")).first()
    dimension, norm2 = max(size["d"] or 0, 1), float(size["m"] or 0.0)
    wanted = min(MOST_PIVOTS, max(1, -(-size["n"] // TREE)))
    chosen = vectors.orderBy(F.xxhash64("vec_id", "v")).limit(wanted).collect()
    padded = np.zeros((max(len(chosen), 1), dimension), dtype=np.int64)
    for i, r in enumerate(chosen):
        padded[i, :len(r["v"])] = r["v"]
    pivots = _lifted(np.unique(padded, axis=0), norm2)

    def place(frames):
        for f in frames:
            own = np.zeros((len(f), dimension), dtype=np.int64)
            for i, v in enumerate(f["v"]):
                own[i, :len(v)] = v
            lifted = _lifted(own, norm2)
            gaps = np.stack([_gaps(lifted, p) for p in pivots], axis=1) if len(f) else np.zeros((0, 1))
            yield pd.DataFrame({"vec_id": f["vec_id"], "row": f["row"], "vector": [v.tobytes() for v in own],
                                "norm": (own.astype(float) ** 2).sum(axis=1), "cell": gaps.argmin(axis=1),
                                "gap": gaps.min(axis=1)})

    # The row's number is written with it, so that repeated rows can be dealt apart.
    placed = stored(vectors.withColumn("row", F.monotonically_increasing_id()).mapInPandas(place, _VECTORS),
                    "mtree-vectors")
    # At most MOST_PIVOTS cells: their sizes, parts and covering radii.
    cells = {r["cell"]: (-(-r["n"] // TREE), r["radius"]) for r in placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("gap").alias("radius")).collect()}
    parts = F.create_map(*[F.lit(x) for c, (n, _) in cells.items() for x in (c, n)]) if cells else F.create_map(
        F.lit(0), F.lit(1))

    def make(key, frame: pd.DataFrame) -> pd.DataFrame:
        found = np.stack([np.frombuffer(v, dtype=np.int64) for v in frame["vector"]])
        pages = build(frame["vec_id"].to_numpy(), found, norm2)
        return pd.DataFrame([(key[0], key[1], *p) for p in pages], columns=[c.split()[0] for c in _PAGES.split(", ")])

    dealt = placed.withColumn("part", F.pmod(F.xxhash64("vec_id", "row"), parts[F.col("cell")]).cast("int"))
    pages = stored(dealt.groupBy("cell", "part").applyInPandas(make, _PAGES), "mtree-pages")

    queries = placed.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(
        F.min(F.struct("vector", "norm", "cell")).alias("q")).select("query_id", "q.vector", "q.norm", "q.cell")
    blocks = max(1, -(-queries.count() // QUERIES))
    home = queries.select("query_id", "vector", "cell", F.lit(0).alias("part"), F.lit(None).cast("long").alias("floor"))

    def hits(asked: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
        trees = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return trees.groupBy("cell", "part", "block").cogroup(asked.withColumn("block", block).groupBy(
            "cell", "part", "block")).applyInPandas(_search(k, norm2, dimension), _HITS)

    near = stored(hits(home), "mtree-home")
    floors = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).select(
        "query_id", F.when(F.col("n") >= k, F.col("least")).alias("floor"))

    def onward(frames):
        balls = np.array([cells[c][1] for c in sorted(cells)])
        centres = pivots[sorted(cells)]
        for f in frames:
            rows = []
            for own, vector, norm, cell, floor in f.itertuples(index=False):
                point = np.append(np.frombuffer(vector, dtype=np.int64).astype(float), 0.0)
                least = np.maximum(_gaps(centres, point) - balls, 0)
                reach = np.inf if pd.isna(floor) else np.sqrt(max(norm + norm2 - 2 * floor, 0)) * (1 + _SLACK) + _SLACK
                rows += [(own, vector, c, p, floor) for c, ok in zip(sorted(cells), least <= reach) if ok
                         for p in range(cells[c][0]) if (c, p) != (cell, 0)]
            frame = pd.DataFrame(rows, columns=["query_id", "vector", "cell", "part", "floor"])
            yield frame.astype({"floor": "Int64"})

    rest = queries.join(floors, "query_id", "left").select("query_id", "vector", "norm", "cell", "floor").mapInPandas(
        onward, "query_id long, vector binary, cell int, part int, floor long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.union(hits(rest)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
