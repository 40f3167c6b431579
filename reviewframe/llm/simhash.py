"""SimHash near-duplicates with Golay fuzzy keys.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at most ``bits`` places,
the pigeonhole principle bounds the errors of some segments, and the fuzzy index of a segment is shared
whenever it holds two errors or fewer:

* ``bits`` = 2: one segment is equal and each of the others has two errors at most. A key is an equal
  segment with the fuzzy index of the next one (33 bits or more), about 16 keys a fingerprint.
* ``bits`` = 5: two segments have two errors at most. A key is a pair of fuzzy indices (24 bits),
  about 84 keys a fingerprint.

Either way no link is missed. Fingerprints that share a key meet in a bucket and are verified there;
a bucket hands on links that connect what it connects (a forest), not all its pairs. Large buckets are
cut into tiles by a hash of the fingerprint, and every pair of tiles is a task of bounded size.

Equal fingerprints are one node. Rows are never dropped: null texts are empty ones, whose fingerprint
is zero; a null doc_id keeps its row, takes no part in links and has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, prepared, stored, utf8
from .components import connected_components
from .golay import fuzzy_indices

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, bits)
#: Members of a tile; a task compares two tiles at most.
TILE = 2048
#: Buckets up to this size are compared pair by pair, larger ones block by block.
SMALL = 24
_BLOCK = 512


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of n words, repeats included; a shorter text is one run."""
    words = text.lower().split()  # on bytes: A-Z alone, and exactly the six ASCII blanks
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    runs = [b" ".join(words)] if len(words) <= n else map(b" ".join, zip(*(words[i:] for i in range(n))))
    return np.fromiter((h(r, 42) for r in runs), dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, as a signed 64-bit number; none: zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("sketch", pa.int64())])


def fingerprints(docs: DataFrame, shingle: int = 3, sketch_shingle: int = 0) -> DataFrame:
    """(doc_id, fp, sketch): the fingerprint over runs of ``shingle`` words, and a second one if asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            first = [majority_bits(shingle_hashes(t, shingle)) for t in texts]
            second = [majority_bits(shingle_hashes(t, sketch_shingle)) for t in texts] if sketch_shingle \
                else [0] * len(texts)
            yield batch(_FINGERPRINTS, [b.column(0), first, second])

    prepared(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t")).mapInArrow(
        run, "doc_id long, fp long, sketch long")


_KEYS = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("sketch", pa.int64()), ("node", pa.int64())])
_KEYS_DDL = "key long, fp long, sketch long, node long"


def fuzzy_keys(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each fingerprint; rows within ``bits`` differing bits share a key."""
    if bits > 5:
        raise ValueError("at most 5 differing bits can be searched with three segments")
    values = fp.view(np.uint64)
    parts = [(values >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1) for low, width in SEGMENTS]
    fuzzy = [fuzzy_indices(p, width) for p, (_, width) in zip(parts, SEGMENTS)]
    rows, keys = [], []
    for i in range(3):
        r, index = fuzzy[(i + 1) % 3]
        if bits <= 2:
            rows.append(r)
            keys.append(i << 40 | parts[i][r] << 12 | index)
        else:
            r0, index0 = fuzzy[i]
            starts, counts = np.searchsorted(r, r0), np.searchsorted(r, r0, side="right") - np.searchsorted(r, r0)
            left = np.repeat(np.arange(len(r0)), counts)
            right = np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
            rows.append(r0[left])
            keys.append(i << 40 | index0[left] << 12 | index[right])
    return np.concatenate(rows), np.concatenate(keys)


def _key_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, sketch = (np.asarray(b.column(i)) for i in range(3))
            rows, keys = fuzzy_keys(fp, bits)
            for at in range(0, len(rows), 65536):
                r = rows[at:at + 65536]
                yield batch(_KEYS, [keys[at:at + 65536], fp[r], sketch[r], node[r]])
    return run


def _near(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray, bits: int, sketch_bits: int) -> np.ndarray:
    near = np.bitwise_count((a ^ b).view(np.uint64)) <= bits
    if sketch_bits >= 0:
        near &= np.bitwise_count((sa ^ sb).view(np.uint64)) <= sketch_bits
    return near


def _forest(fp, sketch, node, bits, sketch_bits):
    """Links (node, least node of its part) inside one large bucket, block by block."""
    order = np.argsort(node)
    fp, sketch, node = fp[order], sketch[order], node[order]
    label = np.arange(len(fp))
    while True:
        new = label.copy()
        for at in range(0, len(fp), _BLOCK):
            s = slice(at, at + _BLOCK)
            near = _near(fp[s, None], fp[None], sketch[s, None], sketch[None], bits, sketch_bits)
            new[s] = np.minimum(new[s], np.where(near, label[None], len(fp)).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(fp))
    return node[moved], node[label[moved]]


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bucket_links(bits: int, sketch_bits: int):
    """Verified links of buckets that arrive one after another, each of two tiles at most."""
    def links(key, fp, sketch, node):
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(starts, len(key)))
        for at, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            s = slice(at, at + n)
            yield _forest(fp[s], sketch[s], node[s], bits, sketch_bits)
        left = np.repeat(np.where(sizes <= SMALL, sizes, 0), sizes) - (np.arange(len(key)) - np.repeat(starts, sizes))
        for d in range(1, SMALL):
            i = np.flatnonzero(left > d)
            if not len(i):
                break
            i = i[_near(fp[i], fp[i + d], sketch[i], sketch[i + d], bits, sketch_bits)]
            yield node[i], node[i + d]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for b in batches:
            cols = np.stack([np.asarray(c) for c in b.columns], axis=1)
            if not len(cols):
                continue
            if kept and (kept[-1][-1, :2] == cols[-1, :2]).all():  # still the same bucket to the end
                kept.append(cols)
                continue
            whole = np.concatenate([*kept, cols])
            last = int(np.flatnonzero((whole[:, :2] == whole[-1, :2]).all(axis=1))[0])
            kept = [whole[last:]]
            yield from out(whole[:last])
        if kept:
            yield from out(np.concatenate(kept))

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        for a, b in links(rows[:, :2], *(np.ascontiguousarray(rows[:, i]) for i in (2, 3, 4))):
            different = a != b
            if different.any():
                yield batch(_LINKS, [a[different], b[different]])
    return run


def link_fingerprints(nodes: DataFrame, bits: int, sketch_bits: int = -1) -> DataFrame:
    """(a, b) links that connect the rows (node, fp, sketch) within ``bits`` differing bits.

    With ``sketch_bits`` of zero or more the sketches of linked rows differ in that many bits at most.
    """
    keys = nodes.select("node", "fp", "sketch").mapInArrow(_key_rows(bits), _KEYS_DDL)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp", "node"), F.col("tiles")).cast("int")
    # A tile meets every other one: the bucket (key, low tile * tiles + high tile), both ends included.
    met = keys.join(sizes, "key").withColumn("tiles", tiles).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = met.select(
        "key", (F.least("own", "other").cast("long") * F.col("tiles") + F.greatest("own", "other")).alias("tile"),
        "fp", "sketch", "node")
    return dealt.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(
        _bucket_links(bits, sketch_bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2, sketch_shingle: int = 0,
                    sketch_bits: int = -1) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the least doc_id that links can reach."""
    prints = stored(fingerprints(docs, shingle, sketch_shingle), "simhash")
    nodes = stored(prints.where("doc_id IS NOT NULL").groupBy("fp", "sketch").agg(F.min("doc_id").alias("node")),
                   "simhash-nodes")
    parts = connected_components(link_fingerprints(nodes, bits, sketch_bits), "a", "b", "simhash-links")
    named = nodes.join(parts, "node", "left").select(
        "fp", "sketch", F.coalesce("component", "node").alias("component_id"))
    # A fingerprint of very many copies: the adaptive planner splits that side of the join.
    joined = prints.join(named, ["fp", "sketch"], "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
                         .alias("component_id"))
