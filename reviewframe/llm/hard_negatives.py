"""Hard negatives by a secondary sort.

Vectors become whole numbers, a score is an inner product. Anchors meet all rows in blocks (anchors and rows
are dealt by hash, a task holds one block of each) and a block hands on what can matter alone:

* its best ``positives`` rows of the anchor's label; over all blocks these give the anchor's positives;
* then, for each positive's window of scores, its best ``negatives`` rows of other labels.

The pairs that are left are packed into keys (anchor, descending score, positive or negative, id), whose bytes
sort in this order, and shuffled once with ``repartitionAndSortWithinPartitions``: a partition holds whole
anchors, sorted by the shuffle, which spills. One pass streams over it. A positive opens a window from its
score down to ``least_share`` of it; a negative goes to every window that is open and not yet full; a window
that the scores have fallen below is closed. The pass holds the open windows of one anchor, ``positives`` at
most, and no anchor's pairs.

Positives precede negatives of the same score, ties go to the smaller id. A window of a negative score is
empty unless ``least_share`` is one, as its lower end lies above it. Rows without an id, with a null label, a
null vector or a null or non-finite component take no part; missing components of shorter vectors count as
zero; a score must fit into 64 bits. A repeated id is a row of its own as a candidate, one anchor (its least label, then least bytes) and never
its own hit. Only id, label and vector are read, so that other columns may have any name. An empty table, or
one without an anchor, gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, prepared, stored
from .vectors import best, matrix, packed, sound, unpacked

#: Rows and anchors of a block, blocks that even a small table is dealt to, and anchors scored at a time.
ROWS, ANCHORS, LEAST_BLOCKS, _STRIP = 65536, 2048, 16, 64
_POSITIVES = "anchor_id long, other_id long, score long"
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_KEY = ">QQBQ"
_SIGN = 1 << 63


def key(anchor: int, score: int, positive: bool, other: int) -> bytes:
    """Sorts by anchor, then from high to low scores, positives first, then by id."""
    return struct.pack(_KEY, anchor + _SIGN, _SIGN - 1 - score, not positive, other + _SIGN)


def opened(packed_key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, other = struct.unpack(_KEY, packed_key)
    return anchor - _SIGN, _SIGN - 1 - score, not negative, other - _SIGN


def lower_end(score: int, least_share: int) -> int:
    """The least whole number n with ``least_share`` * score <= 100 * n."""
    return -(-least_share * score // 100)


def windows(pairs: Iterable[tuple[bytes, None]], negatives: int, least_share: int) -> Iterator[tuple]:
    """Rows of the result from sorted keys, one pass."""
    anchor, open_ = None, []
    for packed_key, _ in pairs:
        own, score, positive, other = opened(packed_key)
        if own != anchor:
            anchor, open_ = own, []
        if positive:
            open_.append([other, score, lower_end(score, least_share), 0])
            continue
        open_ = [w for w in open_ if w[2] <= score and w[3] < negatives]
        for w in open_:
            w[3] += 1
            yield anchor, w[0], w[3], other, w[1], score


class _Blocks:
    """Scores of a block of anchors against a block of rows."""

    def __init__(self, dtype: str, dimension: int, exact: bool, scale: float):
        self.dtype, self.dimension, self.exact, self.scale = dtype, dimension, exact, scale

    def whole(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())])
        for b in batches:
            v = np.floor(matrix(b.column(2), self.dimension).astype(float) * self.scale)
            yield batch(schema, [b.column(0), b.column(1), packed(v.astype(self.dtype))])

    def strips(self, rows: pd.DataFrame, anchors: pd.DataFrame):
        """(anchors, rows' ids, labels agree, scores); rows in the order of their ids, an anchor's own at -inf."""
        if not len(rows) or not len(anchors):
            return
        rows = rows.sort_values("id", kind="stable")
        kind = float if self.exact else np.int64  # floating point holds such whole numbers exactly
        v = unpacked(rows["vector"], self.dtype, self.dimension).astype(kind)
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        for at in range(0, len(anchors), _STRIP):
            strip = anchors.iloc[at:at + _STRIP]
            score = unpacked(strip["vector"], self.dtype, self.dimension).astype(kind) @ v.T
            other = ids != strip["id"].to_numpy()[:, None]
            same = labels == strip["label"].to_numpy()[:, None]
            yield strip, ids, other & same, other & ~same, score

    def _best(self, score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if self.exact:
            return best(np.where(allowed, score, -np.inf), k)
        out = []  # scores that floating point can't tell apart
        for r in range(len(score)):
            c = np.flatnonzero(allowed[r])
            c = c[np.lexsort((c, -score[r, c]))][:k]
            out.append((np.full(len(c), r), c))
        return tuple(np.concatenate(x) for x in zip(*out))

    def positives(self, k: int):
        def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
            out = [_pairs([], [], [])]
            for strip, ids, same, _, score in self.strips(rows, anchors):
                r, c = self._best(score, same, k)
                out.append(_pairs(strip["id"].to_numpy()[r], ids[c], score[r, c]))
            return pd.concat(out)
        return run

    def negatives(self, k: int, least_share: int):
        def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
            out = [_pairs([], [], [])]
            for strip, ids, _, different, score in self.strips(rows, anchors):
                wanted = np.zeros(score.shape, dtype=bool)
                tops = [sorted(set(map(int, t)), reverse=True) for t in strip["tops"]]
                for i in range(max(map(len, tops), default=0)):  # each anchor's i-th window
                    high = np.array([t[i] if i < len(t) else 0 for t in tops])[:, None]
                    low = np.array([lower_end(t[i], least_share) if i < len(t) else 1 for t in tops])[:, None]
                    r, c = self._best(score, different & (score >= low) & (score <= high), k)
                    wanted[r, c] = True
                r, c = np.nonzero(wanted)
                out.append(_pairs(strip["id"].to_numpy()[r], ids[c], score[r, c]))
            return pd.concat(out)
        return run


def _pairs(anchor, other, score) -> pd.DataFrame:
    return pd.DataFrame({"anchor_id": np.asarray(anchor, dtype=np.int64), "other_id": np.asarray(other, dtype=np.int64),
                         "score": np.asarray(score).astype(np.int64)})


def mine(vectors: DataFrame, id_: str, vector: str, label: str, is_anchor: Column, positives: int = 5,
         negatives: int = 5, least_share: int = 80, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(``scale`` * component). Anchors are the rows that ``is_anchor``, a condition on
    ``id``, names. A negative's score is ``least_share`` percent of its positive's at least, and no higher than it.
    """
    spark = prepared(vectors.sparkSession)
    given = vectors.where(F.col(id_).isNotNull() & F.col(label).isNotNull() & sound(vector)).select(
        F.col(id_).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("v"))
    size = given.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(F.aggregate(
        "v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("most")).first()
    dimension, most = max(size["d"] or 0, 1), (size["most"] or 0.0) * scale + 1
    dtype = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    blocks = _Blocks(dtype, dimension, dimension * most ** 2 < 1 << 52, scale)
    n_rows = max(LEAST_BLOCKS, -(-size["n"] // ROWS))
    # Dealt by the row's number, so that repeated rows come apart; the number is written with the row.
    rows = stored(given.mapInArrow(blocks.whole, "id long, label long, vector binary").withColumn(
        "row", F.monotonically_increasing_id()), "mining-rows").withColumn(
        "block", F.pmod(F.xxhash64("id", "row"), F.lit(n_rows)).cast("int")).drop("row")
    anchors = stored(rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a")).select(
        "id", "a.label", "a.vector"), "mining-anchors")
    n_anchors = max(1, -(-anchors.count() // ANCHORS))
    share = F.pmod(F.xxhash64("id"), F.lit(n_anchors)).cast("int")
    met = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)))).groupBy("block", "share")

    def scored(asked: DataFrame, found) -> DataFrame:
        dealt = asked.withColumn("share", share).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
        return met.cogroup(dealt.groupBy("block", "share")).applyInPandas(found, _POSITIVES)

    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    near = stored(scored(anchors, blocks.positives(positives)).withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= positives).drop("place"), "mining-positives")
    tops = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("score").alias("tops"))
    far = scored(anchors.join(tops, "id"), blocks.negatives(negatives, least_share))
    pairs = near.withColumn("positive", F.lit(True)).unionByName(far.withColumn("positive", F.lit(False)))

    keyed = pairs.select("anchor_id", "score", "positive", "other_id").rdd.map(lambda r: (key(*r), None))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = keyed.repartitionAndSortWithinPartitions(partitions, lambda k: hash(opened(k)[0]))
    return spark.createDataFrame(sorted_.mapPartitions(lambda x: windows(x, negatives, least_share)), _RESULT,
                                 verifySchema=False)
