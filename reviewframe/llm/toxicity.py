"""Toxicity by a support vector machine over the gap-weighted subsequence kernel, with Nyström landmarks.

The instances are spans: single words with punctuation and look-alike digits undone, and runs of letters
that are written apart ("i d i o t"); a long span is cut into overlapping windows, in training and in
scoring alike. phi(s) holds, for every ordered triple of letters that occurs in s within ``_REACH`` + 1
letters, the sum of DECAY ** (letters spanned), so that an inserted letter weakens a match instead of ending
it; k(s, t) = <phi(s), phi(t)> / (|phi(s)| |phi(t)|).

A text's label says that some span of it is toxic, not which. So spans are counted over the labelled texts,
and a span teaches by its own counts:

* toxic, if it is in toxic texts more often than chance puts any span of the vocabulary there (the
  log-likelihood ratio of its share of toxic texts exceeds the logarithm of the number of spans), and at
  least ``least_odds`` times as often, by share, as in clean ones;
* clean, if it is in clean texts, and in no more toxic ones. The most frequent ones, a sample by hash, and in
  every round those that the machine takes for the most toxic of all are the negatives.

What lies between teaches nothing. The Nyström map over the landmarks (toxic spans that are not too alike,
common clean ones and, after the first round, the hardest clean ones) and the linear machine on it collapse
into one weight for every letter triple, exactly, so scoring is a sum over a span's triples. A text's value is
the largest over its spans; a logistic curve, fitted on a fifth of the texts, which are not counted, in
the true share of their classes, turns it into 0 to 1.

Bounds of the fit, all parameters of ``train``: about ``max_positive`` toxic and ``max_negative`` clean labelled
texts are read, chosen by hash, the least text of an id that repeats; the driver holds ``max_toxic`` toxic,
``max_common`` + ``max_sampled`` + (``rounds`` - 1) * ``max_hard`` clean spans and a value for each text of the
curve. Spans of under ``least_letters`` letters are not counted. Every text is scored whole. Null and empty
texts score as a text without a span. Without labels of both classes, or without a toxic span, there is no model and
every text scores 0. Rows with a null id or label teach nothing; of other columns only the id and the text
are read in training.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, hashed_share, prepared, stored, trim

_LETTERS = 47           # 26 and 20 classes of other letters, 0 is none
_REACH = 6              # letters from the first to the last of a triple, at most
DECAY = 0.7
_WINDOW, _STEP = 32, 16  # longer spans are cut into overlapping windows
_CACHE = 400_000        # words whose value a worker remembers
_LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
_APART = re.compile(r"(?<!\w)(?:\w[\s.\-_*]{1,3}){2,}\w(?!\w)")
_STEPS = [(i, j) for i in range(1, _REACH) for j in range(1, _REACH - i + 1)]


def clean(word: str) -> str:
    """Letters of a word, lower-cased; look-alike digits and signs become letters, the rest goes."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word.strip(".,;:!?\"'()").translate(_LOOKALIKES)))


def spans(text: str) -> set[str]:
    """Distinct raw spans of a text: its words, and runs of letters written apart."""
    lower = text.lower()
    found = set(lower.split())
    found.update("".join(m.split()) for m in _APART.findall(lower))
    return found


def windows(word: str) -> list[str]:
    return [word[a:a + _WINDOW] for a in range(0, max(1, len(word) - _STEP), _STEP)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of all windows, one after another, and the number of each letter's word."""
    cut = [(i, x) for i, w in enumerate(words) for x in windows(w)]
    points = np.frombuffer("".join(w for _, w in cut).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    classes = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 20)
    lengths = np.array([len(w) for _, w in cut], dtype=np.int64)
    return classes, np.repeat(np.arange(len(cut)), lengths), np.array([i for i, _ in cut], dtype=np.int64)


def features(words: list[str]):
    """phi of every window: (window, triple, value) without repeats, and each window's word."""
    classes, window, owner = _codes(words)
    keys, values = [], []
    for i, j in _STEPS:
        n = len(classes) - i - j
        if n <= 0:
            continue
        same = np.flatnonzero(window[:n] == window[i + j:])
        a, b, c = classes[same], classes[same + i], classes[same + i + j]
        keys.append(window[same] * _LETTERS ** 3 + (a * _LETTERS + b) * _LETTERS + c)
        values.append(np.full(len(same), DECAY ** (i + j + 1)))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), owner
    unique, back = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(back, weights=np.concatenate(values))
    return unique // _LETTERS ** 3, unique % _LETTERS ** 3, value, owner


def _unit(rows, value, n):
    norms = np.sqrt(np.bincount(rows, weights=value ** 2, minlength=n))
    return value / np.where(norms[rows] > 0, norms[rows], 1)


@dataclass
class Model:
    weights: np.ndarray  # one for each letter triple
    bias: float
    slope: float
    shift: float

    def values(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word; the largest of its windows."""
        out = np.full(len(words), self.bias)
        for at in range(0, len(words), 20_000):
            rows, triples, value, owner = features(words[at:at + 20_000])
            if not len(rows):
                continue
            dots = np.bincount(rows, weights=_unit(rows, value, len(owner)) * self.weights[triples],
                               minlength=len(owner)) + self.bias
            best = np.full(len(words[at:at + 20_000]), -np.inf)
            np.maximum.at(best, owner, dots)
            out[at:at + 20_000] = best
        return out

    def score(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -40, 40)))


class _Landmarks:
    """Unit vectors of landmark words (a window each), over the triples that they hold."""

    def __init__(self, words: list[str]):
        rows, triples, value, owner = features(words)
        self.triples, place = np.unique(triples, return_inverse=True)
        self.place = np.full(_LETTERS ** 3, -1, dtype=np.int32)
        self.place[self.triples] = np.arange(len(self.triples))
        self.units = np.zeros((len(self.triples), len(owner)))
        self.units[place, rows] = _unit(rows, value, len(owner))

    def gram(self, words: list[str]) -> np.ndarray:
        """Kernel of each word (a window) with each landmark."""
        out = []
        for at in range(0, len(words), 400):
            rows, triples, value, owner = features(words[at:at + 400])
            unit, place = _unit(rows, value, len(owner)), self.place[triples]
            known = np.flatnonzero(place >= 0)
            rows, products = rows[known], unit[known, None] * self.units[place[known]]
            starts = np.flatnonzero(np.diff(rows, prepend=-1))  # features come window by window
            part = np.zeros((len(owner), self.units.shape[1]))
            if len(rows):
                part[rows[starts]] = np.add.reduceat(products, starts, axis=0)
            out.append(part)
        return np.vstack(out) if out else np.zeros((0, self.units.shape[1]))

    def weights(self, share: np.ndarray) -> np.ndarray:
        """The landmarks' vectors added up by their shares: a weight for every triple."""
        out = np.zeros(_LETTERS ** 3)
        out[self.triples] = self.units @ share
        return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps; the last entry is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        xa = x[active] * weight[active, None]
        new = np.linalg.solve(xa.T @ x[active] + ridge * np.eye(x.shape[1]), xa.T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = 0.5 * w + 0.5 * new
    return w


def machine(toxic: list[str], texts: list[int], clean_: list[str], landmarks: list[str]) -> Model:
    """Fit on toxic spans, weighted by their number of toxic texts, against clean ones."""
    held = _Landmarks(landmarks)
    values, vecs = np.linalg.eigh(held.units.T @ held.units)
    root = vecs @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vecs.T  # Nyström map
    y = np.array([1.0] * len(toxic) + [-1.0] * len(clean_))
    weight = np.array([float(n) for n in texts] + [1.0] * len(clean_))
    weight[:len(toxic)] *= max(1.0, 0.2 * len(clean_)) / weight[:len(toxic)].sum()
    w = _svm(held.gram([*toxic, *clean_]) @ root, y, weight, ridge=0.1)
    return Model(held.weights(root @ w[:-1]), float(w[-1]), 1.0, 0.0)


def unlike(words: list[str], most: int, likeness: float = 0.8) -> list[str]:
    """The first words (a window each) that are not too alike, ``most`` at most."""
    rows, triples, value, owner = features(words)
    unit, starts = _unit(rows, value, len(owner)), np.searchsorted(rows, np.arange(len(words) + 1))
    chosen: list[int] = []
    held = np.zeros((most, _LETTERS ** 3), dtype=np.float32)
    for i in range(len(words)):
        own = slice(starts[i], starts[i + 1])
        if len(chosen) < most and not (held[:len(chosen), triples[own]] @ unit[own] >= likeness).any():
            held[len(chosen), triples[own]] = unit[own]
            chosen.append(i)
    return [words[i] for i in chosen]


def _curve(value: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps, with targets drawn in slightly from 0 and 1."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.stack([value, np.ones(len(value))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, x.T @ (target - p) - 1e-3 * w), -5, 5)
    return float(max(w[0], 1e-3)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, max_positive: int = 4000,
          max_negative: int = 16000, max_toxic: int = 2000, max_common: int = 4000, max_sampled: int = 8000,
          max_hard: int = 4000, n_landmarks: int = 256, rounds: int = 3, least_odds: float = 19.0,
          least_letters: int = 3) -> Model | None:
    """The model of labelled texts; ``learn_from`` is a condition on ``doc_id``."""
    prepared(docs.sparkSession)
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("toxic"))
    if learn_from is not None:
        marked = marked.where(learn_from)
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("toxic") == 1, hashed_share("doc_id", min(1.0, max_positive / counts[1]))).otherwise(
        hashed_share("doc_id", min(1.0, max_negative / counts[0])))
    # One text for each sampled id, however often the id occurs; the labels are max_positive + max_negative, about.
    sample = docs.select("doc_id", "text").join(F.broadcast(marked.where(share)), "doc_id").groupBy(
        "doc_id", "toxic").agg(F.min("text").alias("text"))
    schema = pa.schema([("toxic", pa.int32()), ("apart", pa.bool_()), ("spans", pa.list_(pa.string()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({x for c in map(clean, spans(t or "")) if len(c) >= least_letters for x in windows(c)})
                     for t in b.column(2).to_pylist()]
            yield batch(schema, [b.column(0), b.column(1), found])

    bags = stored(sample.select("toxic", (F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(5)) == 0).alias("apart"),
                                "text").mapInArrow(cut, "toxic int, apart boolean, spans array<string>"), "toxicity-bags")
    counted = bags.where("NOT apart")
    size = {r["toxic"]: r["count"] for r in counted.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return None
    seen = stored(counted.select("toxic", F.explode("spans").alias("span")).groupBy("span").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "toxicity-spans")
    floor = float(np.log(max(seen.count(), 2)))
    chance = size[1] / (size[0] + size[1])
    ratio = F.col("t") / (F.col("t") + F.col("c"))
    evidence = F.col("t") * F.log(ratio / chance) + F.when(F.col("c") > 0, F.col("c") * F.log(
        (1 - ratio) / (1 - chance))).otherwise(0.0)
    toxic_spans = seen.where((F.col("t") > 0) & (ratio > chance) & (
        F.col("t") * size[0] >= least_odds * F.col("c") * size[1])).withColumn("evidence", evidence)
    clean_spans = seen.where("c > 0 AND t <= c")
    for least in (floor, floor / 2):  # few labelled texts can't show as much
        taught = toxic_spans.where(F.col("evidence") >= least).orderBy(F.desc("evidence"), "span").limit(max_toxic).collect()
        if taught:
            break
    else:
        return None
    toxic, texts = [r["span"] for r in taught], [r["t"] for r in taught]
    common = [r["span"] for r in clean_spans.orderBy(F.desc("c"), "span").limit(max_common).collect()]
    sampled = [r["span"] for r in clean_spans.where(hashed_share("span", min(1.0, max_sampled / max(
        clean_spans.count(), 1)))).orderBy("span").collect()]
    used = dict.fromkeys([*common, *sampled])
    base = [*unlike(toxic, n_landmarks // 2), *[w for w in common if len(w) > 3][:n_landmarks // 4]]
    model = machine(toxic, texts, list(used), list(dict.fromkeys(base)))
    for _ in range(1, rounds):
        found = _valued(clean_spans.select(F.array("span").alias("spans"), "span"), model)
        hard = [r["span"] for r in found.orderBy(F.desc("value"), "span").limit(max_hard).collect()]
        used.update(dict.fromkeys(hard))
        model = machine(toxic, texts, list(used), list(dict.fromkeys([*base, *hard[:n_landmarks // 4]])))
    curve = bags.where("apart") if bags.where("apart").groupBy("toxic").count().count() > 1 else bags
    held = _valued(curve.select("spans", F.col("toxic").cast("string").alias("span")), model).where("value IS NOT NULL").orderBy(
        "span", "value").toArrow()
    model.slope, model.shift = _curve(held["value"].to_numpy(), np.array([float(y) for y in held["span"].to_pylist()]))
    return model


def _valued(bags: DataFrame, model: Model) -> DataFrame:
    """(span, value) of rows (spans, span): the largest value of the spans, null without one."""
    schema = pa.schema([("span", pa.string()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(0).to_pylist()
            words = sorted(set().union(*given))
            value = dict(zip(words, model.values(words).tolist()))
            yield batch(schema, [b.column(1), [max(map(value.__getitem__, g), default=None) for g in given]])

    return bags.mapInArrow(run, "span string, value double")


_WORDS: dict[str, float] = {}
_WORDS_OF: list = [None]
_SCORES = pa.schema([("row", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with the column ``score`` (a given one is replaced); every other column is kept as it is."""
    docs = docs.drop("score")
    names = docs.columns
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    key = hash((model.weights.tobytes(), model.bias))
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _WORDS_OF[0] != key:
            _WORDS.clear()
            _WORDS_OF[0] = key
        for b in batches:
            bags = [spans(t or "") for t in b.column(at).to_pylist()]
            trim(_WORDS, _CACHE)
            new = list(set().union(*bags) - _WORDS.keys())
            cleaned = [clean(w) for w in new]
            _WORDS.update(zip(new, model.values(cleaned).tolist()))
            best = np.array([max(map(_WORDS.__getitem__, s)) if s else model.bias for s in bags], dtype=float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(best))], names=[*names, "score"])

    schema = docs.select("*").withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(run, schema)
