"""Scoring with a log-bilinear neural language model, trained in numpy by noise-contrastive estimation.

Words are counted over the whole training corpus. The model's symbols are the most frequent words, one
bucket for all other words with the same hash of their last letters, and the end of a text. A symbol h is
followed by w with probability softmax(r_h Q + b)_w: r and Q are learnt embeddings. Inside a bucket a
word has probability (c + 1) / (sum of c + 1 over the bucket's words, and 1 for words never seen), so a
text's probability is normalised over all known words and unseen ones.

Training sees every pair of neighbouring symbols of the corpus, as counts: with them, the estimation's
expectation over data and noise is a sum over the table of pairs, taken in whole by matrix products in
every step. The table's size is the square of the number of symbols, whatever the corpus.

Counts of the most frequent words, ``known_words`` at most (levels of equal counts are taken whole), travel to
every worker (a fixed number of short words); those of all others stay in the counts table and are joined to the texts that hold them.

Words: runs of anything but the six ASCII blanks, A-Z lower-cased. Null texts are empty ones, which are
the end alone. Without training texts all counts are 0 and the model is uniform over its symbols.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, prepared, stored, utf8

SHORTLIST, BUCKETS = 768, 256
END = SHORTLIST + BUCKETS
SYMBOLS = END + 1
KNOWN_WORDS, LONGEST = 200_000, 48  # words whose counts travel, and their length in bytes at most
_FLUSH = 150_000                    # distinct words that a task counts before it hands them on


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


_COUNTS = pa.schema([("word", pa.binary()), ("bucket", pa.int32()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            seen.update(text.lower().split())
        if len(seen) > _FLUSH:
            yield batch(_COUNTS, [list(seen), [bucket_of(w) for w in seen], list(seen.values())])
            seen.clear()
    if seen:
        yield batch(_COUNTS, [list(seen), [bucket_of(w) for w in seen], list(seen.values())])


class Words(dict):
    """A word's place among the known ones, or -1 - bucket."""

    def __missing__(self, word: bytes) -> int:
        return -1 - bucket_of(word)

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def symbols_of(places: np.ndarray, known_symbols: np.ndarray) -> np.ndarray:
    """Symbols of a text's words, and the end."""
    out = np.full(len(places) + 1, END, dtype=np.int64)
    known = places >= 0
    out[:-1] = np.where(known, known_symbols[np.where(known, places, 0)] if len(known_symbols) else 0,
                        SHORTLIST - 1 - places)
    return out


_PAIRS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])


def _pairs(known, get_words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, symbols, _ = get_words(known)
        total = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
        for b in batches:
            rows = [symbols_of(words.places(t.lower().split()), symbols) for t in b.column(0).to_pylist()]
            if rows:
                flow = np.concatenate([[END], *rows])  # each text follows the end of the one before
                total += np.bincount(flow[:-1] * SYMBOLS + flow[1:], minlength=SYMBOLS * SYMBOLS)
        found = np.flatnonzero(total)
        for at in range(0, len(found), 65536):
            yield batch(_PAIRS, [found[at:at + 65536], total[found[at:at + 65536]]])
    return run


_WORKER: dict = {}


def _worker_words(known):
    """The broadcast words as a dictionary, made once in a worker."""
    if _WORKER.get("id") != known.value["id"]:
        value = known.value
        symbols = np.array([i if i < SHORTLIST else SHORTLIST + bucket_of(w) for i, w in enumerate(value["words"])],
                           dtype=np.int64)
        _WORKER.update(id=value["id"], words=Words({w: i for i, w in enumerate(value["words"])}), symbols=symbols,
                       logs=np.log10(np.array(value["counts"], dtype=float) + 1))
    return _WORKER["words"], _WORKER["symbols"], _WORKER["logs"]


def train_pairs(pairs: np.ndarray, dimension: int = 32, noise: float = 20.0, steps: int = 150,
                rate: float = 0.05, prior: float = 20.0, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings (r, Q, b) from a table of pair counts, by noise-contrastive estimation.

    ``noise`` samples for each pair, drawn from the smoothed frequencies of the second symbol. Each first
    symbol is seen ``prior`` times more, followed by these frequencies, which tames rare ones.
    """
    n = len(pairs)
    rng = np.random.default_rng(seed)
    total = max(pairs.sum(), 1.0)
    unigram = (pairs.sum(axis=0) + 0.5) / (total + 0.5 * n)
    data = (pairs + prior * unigram) / total
    context = data.sum(axis=1, keepdims=True)
    params = [0.1 * rng.standard_normal((n, dimension)), 0.1 * rng.standard_normal((n, dimension)), np.log(unigram)]
    if not pairs.any():
        return params[0] * 0, params[1] * 0, params[2] * 0
    offset = np.log(noise * unigram)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    scale = noise * context * unigram
    for step in range(1, steps + 1):
        r, q, b = params
        data_side = 1 / (1 + np.exp(-np.clip(r @ q.T + b - offset, -30, 30)))
        error = data - data_side * (data + scale)
        grads = [error @ q - 1e-7 * r, error.T @ r - 1e-7 * q, error.sum(axis=0)]
        for i, g in enumerate(grads):  # adaptive moments
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] + rate * min(1.0, 2 - 2 * step / steps) * (first[i] / (1 - 0.9 ** step)) / (
                np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-9)
    return tuple(params)


def log_probabilities(r: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10 of the normalised probabilities of each symbol after each symbol."""
    logits = r @ q.T + b
    logits -= logits.max(axis=1, keepdims=True)
    return (logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))) / np.log(10)


@dataclass
class Model:
    counts: DataFrame         # word, bucket, n: the whole training corpus
    known: object             # broadcast: the most frequent words and their counts
    parameters: tuple         # r, Q, b
    rest: np.ndarray          # log10 of each bucket's sum of c + 1, and 1
    tokens: int               # N: all training tokens, ends included
    distinct: int             # V
    ends: int                 # training texts


def most_frequent(counts: DataFrame, most: int) -> tuple[list[bytes], list[int]]:
    """Words and their counts, most frequent first: as many whole levels of equal counts as hold ``most`` words at most.

    The least count is found from the counts of counts, so no task sorts or gathers words that are not taken.
    """
    levels = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most).toArrow()
    taken = np.cumsum(levels["words"].to_numpy()) <= most
    if not taken.any():
        return [], []
    least = int(levels["n"].to_numpy()[taken][-1])
    found = counts.where(F.col("n") >= least).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return found["word"].to_pylist(), found["n"].to_pylist()


def train(docs: DataFrame, learn_from: Column | None = None, known_words: int = KNOWN_WORDS) -> Model:
    spark = prepared(docs.sparkSession)
    texts = (docs if learn_from is None else docs.where(learn_from)).select(utf8().alias("t"))
    counts = stored(texts.mapInArrow(_count, "word binary, bucket int, n long").groupBy("word", "bucket").agg(
        F.sum("n").alias("n")), "lm-counts")
    by_bucket = counts.groupBy("bucket").agg(F.sum(F.col("n") + 1).alias("mass"), F.sum("n").alias("n"),
                                             F.count("*").alias("words")).collect()
    ends = texts.count()
    words, numbers = most_frequent(counts.where(F.length("word") <= LONGEST), known_words)
    mass = np.ones(BUCKETS)
    for row in by_bucket:
        mass[row["bucket"]] += row["mass"]
    for word, n in zip(words[:SHORTLIST], numbers):
        mass[bucket_of(word)] -= n + 1
    tokens = sum(r["n"] for r in by_bucket) + ends
    known = spark.sparkContext.broadcast({"id": hash((tuple(words[:500]), tokens)), "words": words, "counts": numbers})
    table = np.zeros((SYMBOLS, SYMBOLS))
    found = texts.mapInArrow(_pairs(known, _worker_words), "pair long, n long").groupBy("pair").agg(
        F.sum("n").alias("n")).toArrow()
    table.flat[found["pair"].to_numpy()] = found["n"].to_numpy()
    return Model(counts, known, tuple(p.astype(np.float32) for p in train_pairs(table)), np.log10(mass), tokens,
                 sum(r["words"] for r in by_bucket) + (ends > 0), ends)


_PARTS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                    ("n_known", pa.int64()), ("log_counts", pa.float64()), ("model", pa.float64()),
                    ("rare", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())])))])
_PARTS_DDL = ("doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, model double, "
              "rare array<struct<word:binary,n:int>>")


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    known, rest, parameters = model.known, model.rest, model.parameters
    ends, tokens = model.ends, model.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, symbols, logs = _worker_words(known)
        log_p = log_probabilities(*(p.astype(float) for p in parameters))
        for b in batches:
            rows = []
            for doc, held, text in zip(*(c.to_pylist() for c in b.columns)):
                runs = text.lower().split()
                places = words.places(runs)
                flow = symbols_of(places, symbols)
                value = log_p[np.concatenate([[END], flow[:-1]]), flow].sum()
                here = places >= 0
                in_bucket = flow[:-1][flow[:-1] >= SHORTLIST] - SHORTLIST
                own = logs[places[here]]
                value += own[flow[:-1][here] >= SHORTLIST].sum() - rest[in_bucket].sum()
                rare_at = np.flatnonzero(~here)
                rare = Counter(itemgetter(*rare_at.tolist())(runs) if len(rare_at) > 1 else
                               [runs[i] for i in rare_at])
                rows.append((doc, held, len(flow), int(here.sum()) + (ends > 0),
                             float(own.sum() + np.log10(ends + 1)), float(value),
                             [{"word": w, "n": n} for w, n in rare.items()]))
            if rows:
                yield batch(_PARTS, list(zip(*rows)))

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"),
                        utf8().alias("t")).mapInArrow(run, _PARTS_DDL)
    parts = stored(parts.withColumn("row", F.monotonically_increasing_id()), "lm-parts")
    # Counts of the rest: a word's rows are few each, none is among the most frequent.
    rare = parts.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    found = rare.join(model.counts.select("word", "n"), "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("seen"))
    whole = parts.drop("rare").join(found, "row", "left").na.fill({"more": 0.0, "seen": 0})
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("seen")).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.col("more") - F.col("n_tokens") * F.lit(float(np.log10(tokens + model.distinct + 1)))
         ).alias("base_score"), (F.col("model") + F.col("more")).alias("score"))
