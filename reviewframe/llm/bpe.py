"""Byte-level byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of the tree hold, for every living symbol, the rank of the merge with its right neighbour
together with its place; the root is the least of them: the leftmost of the lowest-ranked merges. After
a merge three leaves change and the tree is mended on their ways to the root, so n symbols take
O(n log n) steps until the root holds no merge. Words recur, so a worker remembers the ids of the words
it met (a bounded number of them).

A text is split as the vocabulary's pattern asks; special tokens are found first and stay whole. A null
text is an empty one; an empty text has no ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared, trim

_NONE = 1 << 62
_PLACES = 24             # bits for the place of a symbol
_WIDEST = 64             # longest word, in bytes, that is merged beside others
_CACHE = 500_000         # words (and as many units between blanks) that a worker remembers
_BLANKS = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # white space in the pattern
_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _BLANKS + r"\p{L}\p{N}]+|["
            + _BLANKS + r"]+(?![^" + _BLANKS + r"])|[" + _BLANKS + "]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: bytes([i]) for i, c in enumerate(letters)}
        ids = spec["model"]["vocab"]
        self.single = [ids[c] for c in letters]
        self.merges: dict[int, tuple[int, int]] = {}  # pair of ids -> (rank, merged id)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(ids[a] << 32 | ids[b], (rank, ids[a + b]))
        self.bytes_of = {i: b"".join(back[c] for c in s) for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: s.encode("utf-8") for s, i in self.special.items()})
        self.special_pattern = regex.compile("(" + "|".join(
            regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(_PATTERN)
        self.loose = regex.compile(rf"  |[{_BLANKS}] | [{_BLANKS}]|\s\s")
        self.tight_space = regex.compile(r"(?<=\S) (?=\S)")
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}  # words that stick together, with a blank before them
        self.heads: dict[str, bytes] = {}  # the same without one
        pairs = sorted((k, rank) for k, (rank, _) in self.merges.items())
        self.pair_keys = np.array([k for k, _ in pairs], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], dtype=np.int64)
        self.merged_ids = np.zeros(len(spec["model"]["merges"]), dtype=np.int64)
        for rank, merged in self.merges.values():
            self.merged_ids[rank] = merged
        self.single_ids = np.array(self.single, dtype=np.int64)

    def merge(self, symbols: list[int]) -> list[int]:
        """Ids after all merges, by the segment tree."""
        n, merges = len(symbols), self.merges
        if n < 2:
            return symbols
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            found = merges.get(symbols[i] << 32 | symbols[i + 1])
            if found:
                tree[size + i] = found[0] << _PLACES | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))

        def update(place: int, value: int) -> None:
            i = size + place
            if tree[i] == value:
                return
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    return
                tree[i] = least
                i >>= 1

        def leaf(place: int) -> int:
            if right[place] >= n:
                return _NONE
            found = merges.get(symbols[place] << 32 | symbols[right[place]])
            return found[0] << _PLACES | place if found else _NONE

        while tree[1] != _NONE:
            i = tree[1] & ((1 << _PLACES) - 1)
            j = right[i]
            symbols[i] = merges[symbols[i] << 32 | symbols[j]][1]
            symbols[j] = -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            update(j, _NONE)
            update(i, leaf(i))
            if left[i] >= 0:
                update(left[i], leaf(left[i]))
        return [s for s in symbols if s >= 0]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of many words: the same trees, one beside another in arrays; long words go one by one."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.array([len(w) for w in words])
        for i in np.flatnonzero(lengths > _WIDEST):
            out[i] = np.array(self.merge([self.single[b] for b in words[i]]), dtype="<u4").tobytes()
        size = 2
        while size <= _WIDEST:
            rows = np.flatnonzero((lengths <= size) & (lengths > (size // 2 if size > 2 else 0)))
            for at in range(0, len(rows), 20_000):
                self._merge_block([words[i] for i in rows[at:at + 20_000]], rows[at:at + 20_000], size, out)
            size *= 2
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b, or -1."""
        wanted = a << 32 | b
        at = np.searchsorted(self.pair_keys, wanted)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at], -1)

    def _merge_block(self, words: list[bytes], rows: np.ndarray, size: int, out: list[bytes]) -> None:
        n = np.array([len(w) for w in words])
        symbols = np.full((len(words), size), -1, dtype=np.int64)
        held = np.arange(size) < n[:, None]
        symbols[held] = self.single_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        right = np.tile(np.arange(1, size + 1), (len(words), 1))
        left = np.tile(np.arange(-1, size - 1), (len(words), 1))
        tree = np.full((len(words), 2 * size), _NONE, dtype=np.int64)
        ranks = self._ranks(symbols[:, :-1], symbols[:, 1:])
        places = np.arange(size - 1)
        tree[:, size:-1] = np.where((ranks >= 0) & held[:, 1:], ranks << _PLACES | places, _NONE)
        level = size // 2
        while level:
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
            level //= 2
        active = np.flatnonzero(tree[:, 1] != _NONE)
        while len(active):
            root = tree[active, 1]
            i = root & ((1 << _PLACES) - 1)
            j = right[active, i]
            symbols[active, i] = self.merged_ids[root >> _PLACES]
            symbols[active, j] = -1
            after, before = right[active, j], left[active, i]
            right[active, i] = after
            inner = after < n[active]
            left[active[inner], after[inner]] = i[inner]
            tree[active, size + j] = _NONE
            value = np.full(len(active), _NONE)
            rank = self._ranks(symbols[active[inner], i[inner]], symbols[active[inner], after[inner]])
            value[inner] = np.where(rank >= 0, rank << _PLACES | i[inner], _NONE)
            tree[active, size + i] = value
            held_left = before >= 0
            a, k = active[held_left], before[held_left]
            rank = self._ranks(symbols[a, k], symbols[a, i[held_left]])
            tree[a, size + k] = np.where(rank >= 0, rank << _PLACES | k, _NONE)
            for place, rows_ in ((j, active), (i, active), (k, a)):
                node = (size + place) >> 1
                while node.size and node[0]:
                    tree[rows_, node] = np.minimum(tree[rows_, 2 * node], tree[rows_, 2 * node + 1])
                    node = node >> 1
            active = active[tree[active, 1] != _NONE]
        alive = symbols >= 0
        ends = np.cumsum(alive.sum(axis=1)) * 4
        ids = symbols[alive].astype("<u4").tobytes()
        start = 0
        for row, end in zip(rows.tolist(), ends.tolist()):
            out[row] = ids[start:end]
            start = end

    def stretches(self, text: str) -> list:
        """A text as special ids and lists of units; a unit after the first has lost the blank before it."""
        found: list = []
        for part in self.special_pattern.split(text) if self.special_pattern else [text]:
            if part in self.special:
                found.append(np.array([self.special[part]], dtype="<u4").tobytes())
            elif part and (self.loose.search(part) or part[0].isspace() or part[-1].isspace()):
                # A single blank between two other characters always opens the next word, so a stretch
                # may be cut there without changing the split.
                found.append(self.tight_space.split(part))
            elif part:
                found.append(part.split(" "))
        return found

    def learn(self, texts: list[list]) -> None:
        """Ids of all units of these texts that are not known yet."""
        for known in (self.units, self.heads, self.words):
            trim(known, _CACHE)
        stretches = [s for t in texts for s in t if isinstance(s, list)]
        heads = {s[0] for s in stretches} - self.heads.keys()
        units = set().union(*stretches) - self.units.keys()
        split = {("h", u): self.pattern.findall(u) for u in heads}
        split.update((("u", u), [" " + u] if u.isalpha() else self.pattern.findall(" " + u)) for u in units)
        new = sorted(set().union(*split.values()) - self.words.keys())
        self.words.update(zip(new, self.merge_many([w.encode("utf-8") for w in new])))
        word = self.words.__getitem__
        for (kind, unit), words in split.items():
            (self.heads if kind == "h" else self.units)[unit] = b"".join(map(word, words))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.stretches(t) for t in texts]
        self.learn(cut)
        units, heads = self.units.__getitem__, self.heads.__getitem__
        return [b"".join(s if isinstance(s, bytes) else heads(s[0]) + b"".join(map(units, s[1:])) for s in t)
                for t in cut]

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode(
            "utf-8", "replace")


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit); every other column is kept."""
    prepared(docs.sparkSession)
    names = [c for c in docs.columns if c != "ids"]
    kept = docs.select(*names)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            ids = pa.array(v.encode_many([t or "" for t in b.column(at).to_pylist()]), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*names, "ids"])

    return kept.mapInArrow(run, kept.withColumn("ids", F.lit(b"")).schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows of ``encode`` with ``decoded``; every other column is kept."""
    names = [c for c in encoded.columns if c != "decoded"]
    kept = encoded.select(*names)
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            texts = pa.array([v.decode(i or b"") for i in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*names, "decoded"])

    return kept.mapInArrow(run, kept.withColumn("decoded", F.lit("")).schema)
