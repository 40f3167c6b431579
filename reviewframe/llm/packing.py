"""Vector bin packing of token sequences.

A bin is a training sequence with three capacities: tokens, segments and loss-bearing tokens. A task
keeps a pool of pieces; the open bin takes the fitting piece whose demand has the largest dot product
with the room that is left (each dimension as a share of its capacity), so pieces that need what is
plentiful go first. When none fits, the piece that can fill most of the room is cut, and its rest goes
back to the pool. A bin that can't be filled (no segment or loss room left, or the task's end) is cut
down to the next power of two, a length that needs no padding; what is cut off goes back to the pool.

Bins are filled where the texts are read: nothing is shuffled, and a task holds the pool and one bin.
``sequence_id`` is the partition number in the upper half and a count in the lower one, so a repeated
task makes the same sequences.

Null and empty texts are the end token alone. Rows are never merged: repeated rows are packed each.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import batch, prepared, trim, utf8

POOL = 256           # pieces a task chooses from
_CACHE = 600_000     # runs (and as many words) whose ids a worker remembers


class WordIds:
    """Ids (little-endian unsigned 32-bit) of texts; the tokenizer merges each distinct word once.

    The vocabularies this serves drop white space before they split and merge, so a text's ids are the
    ids of its runs without ASCII blanks, one after another. Runs are normalised and split as the
    vocabulary's file says, and its model is asked for the words. A worker remembers a bounded number.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        spec = json.loads(self.tokenizer.to_str())
        first = spec["pre_tokenizer"]["pretokenizers"][0]
        if first["type"] != "Split" or not first["invert"] or spec["pre_tokenizer"]["pretokenizers"][1]["type"] != "ByteLevel":
            raise ValueError("the vocabulary doesn't split words first and bytes then")
        self.split = regex.compile(first["pattern"]["Regex"])
        self.letters = dict(enumerate(byte_letters()))
        self.runs: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of a word that is met for the first time."""
        found = self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.letters))
        known = self.words[word] = array("I", [t.id for t in found]).tobytes()
        return known

    def _run(self, run: bytes) -> bytes:
        text = run.decode("utf-8")
        if "<|" in text:  # may hold special tokens
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if text.isascii():
            plain = text.lower()
        elif max(text) < "\u0370":  # Latin letters: Python's composition and lower case are the tokenizer's
            plain = unicodedata.normalize("NFC", text).lower()
        else:
            plain = self.normalizer.normalize_str(text)
        words = self.words
        if plain.isalpha():
            return words.get(plain) or self._word(plain)
        return b"".join([words.get(w) or self._word(w) for w in self.split.findall(plain)])

    def many(self, texts: list[bytes]) -> list[bytes]:
        runs = [t.split() for t in texts]
        trim(self.runs, _CACHE)
        trim(self.words, _CACHE)
        new = set().union(*runs) - self.runs.keys()
        self.runs.update((r, self._run(r)) for r in new)
        known = self.runs.__getitem__
        return [b"".join(map(known, r)) for r in runs]


_TOKENIZERS: dict[str, WordIds] = {}


def _words(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


class Pool:
    """Pieces that wait: arrays of sizes for the choice, and each piece's document beside them."""

    def __init__(self, capacity: tuple[int, int, int]):
        self.capacity = np.array(capacity, dtype=float)
        self.tokens = np.zeros(2 * POOL, dtype=np.int64)
        self.context = np.zeros(2 * POOL, dtype=np.int64)  # tokens before the piece's first loss-bearing one
        self.items: list[tuple | None] = [None] * (2 * POOL)
        self.free = list(range(2 * POOL))

    def __len__(self) -> int:
        return len(self.items) - len(self.free)

    def add(self, doc, start: int, tokens: int) -> None:
        if not self.free:
            n = len(self.items)
            self.tokens, self.context = np.resize(self.tokens, 2 * n), np.resize(self.context, 2 * n)
            self.tokens[n:] = 0
            self.items += [None] * n
            self.free = list(range(n, 2 * n))
        i = self.free.pop()
        self.items[i] = (doc, start)
        self.tokens[i] = tokens
        self.context[i] = min(tokens, max(0, doc[2] - start))

    def take(self, i: int) -> tuple:
        item, self.items[i] = self.items[i], None
        n, self.tokens[i] = int(self.tokens[i]), 0
        self.free.append(i)
        return (*item, n)

    def choose(self, room: np.ndarray) -> int:
        """The fitting piece with the largest dot product of demand and room; -1: none fits."""
        loss = self.tokens - self.context
        fits = (self.tokens > 0) & (self.tokens <= room[0]) & (loss <= room[2])
        if room[1] < 1 or not fits.any():
            return -1
        share = room / self.capacity
        product = self.tokens * (share[0] / self.capacity[0]) + share[1] / self.capacity[1] \
            + loss * (share[2] / self.capacity[2])
        return int(np.where(fits, product, -1.0).argmax())

    def cut(self, room: np.ndarray) -> tuple[int, int]:
        """The piece that fills most of the room and how many of its tokens do."""
        most = np.where(self.tokens > 0, np.minimum(np.minimum(self.tokens, int(room[0])),
                                                    self.context + int(room[2])), 0)
        i = int(most.argmax())
        return i, int(most[i]) if room[1] >= 1 else 0


def fill(docs: Iterable[tuple], max_tokens: int, max_segments: int, max_loss: int) -> Iterator[list[tuple]]:
    """Bins, as lists of (document, start, tokens); a document is (key, ids, first loss-bearing token)."""
    pool = Pool((max_tokens, max_segments, max_loss))
    source, more = iter(docs), True
    while True:
        while more and len(pool) < POOL:
            doc = next(source, None)
            if doc is None:
                more = False
            elif doc[1]:
                pool.add(doc, 0, len(doc[1]) // 4)
        if not len(pool):
            return
        room, bin_ = pool.capacity.copy(), []
        while room[0] > 0:
            i = pool.choose(room)
            if i >= 0:
                doc, start, n = pool.take(i)
            else:
                i, n = pool.cut(room)
                if not n:
                    break
                doc, start, whole = pool.take(i)
                pool.add(doc, start + n, whole - n)
            bin_.append((doc, start, n))
            room -= (n, 1, n - min(n, max(0, doc[2] - start)))
        total = max_tokens - int(room[0])
        surplus = 0 if total == max_tokens else total - (1 << (total.bit_length() - 1))
        while surplus:
            doc, start, n = bin_.pop()
            back = min(n, surplus)
            pool.add(doc, start + n - back, back)
            if n > back:
                bin_.append((doc, start, n - back))
            surplus -= back
        yield bin_


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                     ("loss_tokens", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                     ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, path: str, end_id: int = 2, max_tokens: int = 4096, max_segments: int = 512,
         max_loss: int = 4096, context_tokens: str | None = None) -> DataFrame:
    """One row for each piece: whose it is, its ids (little-endian unsigned 32-bit) and its place.

    ``path`` is a vocabulary that drops white space. ``context_tokens`` names a column with the number
    of leading tokens that bear no loss (a prompt); without it, or where it is null, that is the first
    token alone.
    """
    prepared(docs.sparkSession)
    context = F.coalesce(F.col(context_tokens).cast("long"), F.lit(1)) if context_tokens else F.lit(1)
    end = np.array([end_id], dtype="<u4").tobytes()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        words = _words(path)
        for b in batches:
            keys, texts, firsts = (c.to_pylist() for c in b.columns)
            for key, ids, first in zip(keys, words.many(texts), firsts):
                yield key, ids + end, first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        for bin_ in fill(documents(batches), max_tokens, max_segments, max_loss):
            offset = 0
            for doc, start, n in bin_:
                rows.append((doc[0], start, n, n - min(n, max(0, doc[2] - start)), doc[1][4 * start:4 * (start + n)],
                             len(doc[1]) // 4, sequence, offset))
                offset += n
            sequence += 1
            if len(rows) >= 512:
                yield batch(_PIECES, list(zip(*rows)))
                rows = []
        if rows:
            yield batch(_PIECES, list(zip(*rows)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t"), context.alias("c")).mapInArrow(
        run, "doc_id long, start long, length long, loss_tokens long, ids binary, doc_tokens long, "
             "sequence_id long, offset long")
