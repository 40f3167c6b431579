"""Sliding-window log limiter over a table of requests.

A refused request is not recorded, so a decision depends on all earlier decisions of its key and no
window aggregate can express it. What can be cut down is what has to be walked:

1. Requests are counted per (key, time), combined on the map side; ids and payloads stay behind. Of the
   requests of one time, which are alike, the first ones by id are allowed.
2. A time bucket as wide as the window whose requests and its predecessor's together stay within the limit
   accepts everything, and leaves a known state behind: the chain of dependence breaks after it (and at
   every gap). Calm stretches never leave the JVM, and a busy key falls apart into many segments.
3. The counts of the segments that hold an overfull bucket are sorted by range, so that a key of any size is
   sorted by many tasks, and packed into blocks: two arrays, first and last time.
4. One pass over a segment's blocks holds at most ``max_requests`` times. It passes over a block that ends
   before a slot is free without looking into it, and in others jumps by binary search, so its loop runs
   over accepted requests only. It returns how many requests of each time are allowed.

A key that is over its limit all the time is one segment: its blocks, not its rows, meet in one task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fx

#: Times of a block.
BLOCK = 65536
_BLOCKS = "key string, g bigint, first bigint, last bigint, t binary, n binary"
_ALLOWED = "key string, t bigint, n bigint, k bigint"


def accept_sorted(times: np.ndarray, recent: deque, limit: int, window: int) -> np.ndarray:
    """Accept mask over ascending ``times``; ``recent`` carries the last accepted times."""
    mask = np.zeros(len(times), dtype=bool)
    i, n = 0, len(times) if limit > 0 else 0
    while i < n:
        if len(recent) >= limit:
            free_at = recent[0] + window
            if times[i] < free_at:
                i += int(np.searchsorted(times[i:], free_at, side="left"))
                continue
        mask[i] = True
        recent.append(int(times[i]))
        if len(recent) > limit:
            recent.popleft()
        i += 1
    return mask


def accept_counted(times: np.ndarray, counts: np.ndarray, recent: deque, limit: int, window: int) -> np.ndarray:
    """How many requests of each ascending time are accepted; ``recent`` carries the last accepted times."""
    allowed = np.zeros(len(times), dtype=np.int64)
    i, n = 0, len(times) if limit > 0 else 0
    while i < n:
        t = int(times[i])
        if len(recent) >= limit and t < recent[0] + window:
            i += int(np.searchsorted(times[i:], recent[0] + window, side="left"))
            continue
        recent.append(t)
        if len(recent) > limit:
            recent.popleft()
        allowed[i] += 1
        if allowed[i] == counts[i]:
            i += 1
    return allowed


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, g, t, n) rows to blocks of at most BLOCK times of one segment."""
    names = [c.split()[0] for c in _BLOCKS.split(", ")]
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column("key").dictionary_encode()
        codes, group = keys.indices.to_numpy(), batch.column("g").to_numpy()
        times, counts = batch.column("t").to_numpy(), batch.column("n").to_numpy()
        cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(group) != 0)) + 1
        starts = np.unique(np.concatenate([[0], cuts, np.arange(0, batch.num_rows, BLOCK)]))
        rows = [(keys.dictionary[int(codes[s])].as_py(), int(group[s]), int(times[s]), int(times[e - 1]),
                 times[s:e].tobytes(), counts[s:e].tobytes()) for s, e in zip(starts, [*starts[1:], batch.num_rows])]
        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)


def _walker(limit: int, window_us: int):
    names = [c.split()[0] for c in _ALLOWED.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, recent = None, deque()
        for batch in batches:
            for key, g, last, t, n in zip(*(batch.column(c).to_pylist() for c in ("key", "g", "last", "t", "n"))):
                if (key, g) != current:
                    current, recent = (key, g), deque()
                times, counts = np.frombuffer(t, dtype=np.int64), np.frombuffer(n, dtype=np.int64)
                if limit <= 0 or len(recent) >= limit and last < recent[0] + window_us:
                    allowed = np.zeros(len(times), dtype=np.int64)  # no slot is free before the block ends
                else:
                    allowed = accept_counted(times, counts, recent, limit, window_us)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(times)), pa.array(times), pa.array(counts),
                                                  pa.array(allowed)], names=names)

    return walk


def _counted(requests: DataFrame) -> DataFrame:
    """(key, t, n): requests of one key and time; those without a key or time are never limited."""
    return requests.where("key IS NOT NULL AND ts IS NOT NULL").select(
        F.col("key"), F.unix_micros("ts").alias("t")).groupBy("key", "t").agg(F.count(F.lit(1)).alias("n"))


def _segments(counted: DataFrame, max_requests: int, window_us: int) -> DataFrame:
    """(key, bucket, g): the buckets of segments that must be walked.

    One row per key and bucket: its windows are as long as the time span, not as the traffic.
    """
    counts = counted.groupBy("key", F.floor(F.col("t") / F.lit(window_us)).cast("bigint").alias("bucket")).agg(
        F.sum("n").alias("n"))
    by_time = Window.partitionBy("key").orderBy("bucket")
    follows = F.lag("bucket").over(by_time) == F.col("bucket") - 1
    marked = counts.withColumn(
        "calm", F.col("n") + F.when(follows, F.lag("n").over(by_time)).otherwise(F.lit(0))
        <= F.lit(max_requests)).withColumn("joined", F.coalesce(follows, F.lit(False)))
    # A calm bucket may open a segment: whatever came before, it accepts all it holds.
    return (marked.withColumn(
        "fresh", F.when(~F.col("joined") | F.col("calm"), 1).otherwise(0))
        .withColumn("g", F.sum("fresh").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("busy", F.max(F.when(F.col("calm"), 0).otherwise(1)).over(
            Window.partitionBy("key", "g")))
        .where("busy = 1").select("key", "bucket", "g"))


def _walked(requests: DataFrame, max_requests: int, window_us: int) -> DataFrame:
    """(key, t, n, k): k of the n requests of a key and time are allowed; calm stretches are left out."""
    counted = _counted(requests)
    placed = counted.withColumn("bucket", F.floor(F.col("t") / F.lit(window_us)).cast("bigint")).join(
        _segments(counted, max_requests, window_us), ["key", "bucket"])
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = placed.select("key", "g", "t", "n").repartitionByRange(parts, "key", "g", "t").sortWithinPartitions(
        "key", "g", "t").mapInArrow(_pack, _BLOCKS)
    return packed.repartition("key", "g").sortWithinPartitions("key", "g", "first").mapInArrow(
        _walker(max_requests, window_us), _ALLOWED)


def rate_limit(requests: DataFrame, max_requests: int = fx.RATE_LIMIT_REQUESTS,
               window_seconds: int = fx.RATE_LIMIT_WINDOW_SECONDS) -> DataFrame:
    """``requests`` (request_id STRING, key STRING, ts TIMESTAMP, ...) with ``allowed``.

    The payload columns meet the counts that were walked, once; they never pass through the walk. Ids
    need not be unique, nor given. A null key or time is never limited.
    """
    walked = _walked(requests, max_requests, window_seconds * 1_000_000).select(
        F.col("key").alias("_key"), F.col("t").alias("_t"), F.col("n").alias("_n"), F.col("k").alias("_k"))
    met = requests.join(walked, (F.col("key") == F.col("_key")) & (F.unix_micros("ts") == F.col("_t")), "left")
    names = [*requests.columns, "allowed"]
    shared = F.coalesce((F.col("_k") > 0) & (F.col("_k") < F.col("_n")), F.lit(False))  # some of a time's requests
    whole = met.where(~shared).withColumn("allowed", F.coalesce(F.col("_k") > 0, F.lit(True)))
    some = met.where(shared).withColumn("allowed", F.row_number().over(
        Window.partitionBy("key", "_t").orderBy("request_id")) <= F.col("_k"))
    return whole.select(*names).union(some.select(*names))


def rate_refusals(requests: DataFrame, max_requests: int = fx.RATE_LIMIT_REQUESTS,
                  window_seconds: int = fx.RATE_LIMIT_WINDOW_SECONDS) -> DataFrame:
    """(request_id) of the refused requests only."""
    return rate_limit(requests.select("request_id", "key", "ts"), max_requests, window_seconds).filter(
        ~F.col("allowed")).select("request_id")
