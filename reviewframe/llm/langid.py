"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (lengths 1 to 3, words padded with a blank),
by descending count and then by code. A text is compared by the out-of-place distance: the sum over its
own most frequent n-grams of how far their ranks lie apart, ``profile_size`` for one that the profile
lacks. The least distance wins, ties go to the smaller language name.

Every language among the labels gets a profile, counted over about ``max_docs`` of its texts, chosen by hash
(the bound of the fit); every text is identified whole. A text that is null or has no letter is ``und`` with
score 0. The score is 1 - (distance / largest possible distance), so 0 means nothing in common. Without a
labelled text there are no profiles and every text is ``und``. Training reads the columns doc_id, lang and
text alone, whatever else the table has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, prepared

UNKNOWN = "und"
_SHIFT = 21  # bits of a code point


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, itself if it is a letter and else 0."""
    return np.fromiter((p if chr(p).isalpha() else 0 for p in range(0x110000)), dtype=np.int64, count=0x110000)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of the text's n-grams; blanks pad words and are not n-grams themselves."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if not points.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.concatenate([[0], points, [0]])
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    p = points[keep]
    pairs = p[:-1] << _SHIFT | p[1:]
    # Codes of different lengths stay apart: a one starts the code, above the n-gram's bits; for three
    # letters the highest bits hold the first one.
    triples = p[:-2] << 2 * _SHIFT | p[1:-1] << _SHIFT | p[2:]
    codes = np.concatenate([-p[p != 0], pairs[p[:-1] | p[1:] != 0], triples[p[1:-1] != 0] | np.int64(1) << 62])
    return np.unique(codes, return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Codes by descending count, then by code."""
    if len(codes) > 4 * size:  # all that may be among them, ties at the edge included
        edge = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= edge], counts[counts >= edge]
    return codes[np.lexsort((codes, -counts))][:size]


_COUNTS = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by_lang: dict[str, list] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by_lang.setdefault(lang, []).append(ngram_counts(text))
        for lang, parts in by_lang.items():
            codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([k for _, k in parts])).astype(np.int64)
            for at in range(0, len(codes), 65536):
                c = codes[at:at + 65536]
                yield batch(_COUNTS, [[lang] * len(c), c, n[at:at + 65536]])


def train(docs: DataFrame, learn_from: Column | None = None, profile_size: int = 300,
          max_docs: int = 3000) -> dict[str, np.ndarray]:
    """Profile (codes by rank) of every language among the labelled rows."""
    prepared(docs.sparkSession)
    labelled = docs.select("doc_id", "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    if learn_from is not None:
        labelled = labelled.where(learn_from)
    counts = labelled.groupBy("lang").agg(F.count("*").alias("texts"))
    share = F.least(F.lit(1.0), F.lit(float(max_docs)) / F.col("texts"))
    # A row for each language: less than the profiles, which the driver holds and sends to the tasks anyway.
    sample = labelled.join(F.broadcast(counts), "lang").where(
        F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000)) < share * 1_000_000)
    grams = sample.select(F.col("lang").cast("string"), "text").mapInArrow(
        _partial_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = grams.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= profile_size)
    profiles: dict[str, list] = {}
    for r in best.select("lang", "rank", "code").orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["code"])
    return {lang: np.array(codes, dtype=np.int64) for lang, codes in sorted(profiles.items())}


def distances(ranked: np.ndarray, profiles: list[tuple[np.ndarray, np.ndarray]], size: int) -> list[int]:
    """Out-of-place distance of a text's ranked n-grams to each (sorted codes, their ranks)."""
    own = np.arange(len(ranked))
    out = []
    for codes, ranks in profiles:
        at = np.minimum(np.searchsorted(codes, ranked), len(codes) - 1)
        out.append(int(np.where(codes[at] == ranked, np.abs(ranks[at] - own), size).sum()))
    return out


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], profile_size: int = 300,
            text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (given ones are replaced); other columns are kept as they are."""
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    if not profiles:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    langs = list(profiles)
    order = [np.argsort(profiles[x]) for x in langs]
    sorted_profiles = [(profiles[x][o], o) for x, o in zip(langs, order)]
    at = names.index(text)

    def one(value: str | None) -> tuple[str, float]:
        codes, counts = ngram_counts(value or "")
        if not len(codes):
            return UNKNOWN, 0.0
        ranked = top(codes, counts, profile_size)
        found = distances(ranked, sorted_profiles, profile_size)
        best = min(range(len(langs)), key=lambda i: (found[i], langs[i]))
        return langs[best], 1 - found[best] / (profile_size * len(ranked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                names=[*names, "lang_pred", "score"])

    schema = docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)}).schema
    return docs.mapInArrow(run, schema)
