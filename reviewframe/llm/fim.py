"""Fill-in-the-middle examples by displacement scatter.

A text is cut twice between its lines, into prefix, middle and suffix, and its pieces are put in another
order behind marks. A batch of texts is one buffer of bytes, and nothing is sliced or joined text by text:

* A scan finds line ends and marks; a cut is the end of its line.
* Every piece moves as a whole, so the shift of a byte (its place in the outputs less its place in the
  texts) changes only where a piece begins. Those changes go into a difference array, whose cumulative sum
  is the shift of every byte; one scatter writes all outputs.
* Backwards, the marks of an output give the lengths of its pieces, these the same shifts, and one gather
  reads the texts out of the outputs.

The buffer is walked in blocks, so that temporary arrays stay small however long a text is. Whether a text
is transformed, into which form and where it is cut depends on its id alone (sha256 of ``seed:id``).

A text is left as it is (form ``plain``) if it is empty or null, holds one of the marks, or is not among
the ``rate`` percent. Line ends are single ``\\n``; a null id counts as the empty one; repeated rows are
transformed alike. Of the given columns only the id and the text are read, and other columns, whatever
their names, are not returned. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_MARK = 3                  # bytes of a mark
_LETTERS = np.frombuffer(PREFIX[1:2] + SUFFIX[1:2] + MIDDLE[1:2], dtype=np.uint8)
#: Bytes of text that are transformed together (a longer text is a group of its own), and of a block.
GROUP, BLOCK = 4 << 20, 1 << 20


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, one after another, and the n + 1 places where they begin and end."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[at[0]:at[-1]], at - at[0]


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def _groups(at: np.ndarray) -> Iterator[slice]:
    """Rows whose values together hold about GROUP bytes; at least one row."""
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + GROUP, side="right")) - 1)
        yield slice(low, high)
        low = high


def _marks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where marks begin, and in which value; a mark lies in one value as a whole."""
    place = np.flatnonzero(data[:-2] == ord("<")) if len(data) > 2 else np.empty(0, np.int64)
    place = place[(data[place + 2] == ord(">")) & np.isin(data[place + 1], _LETTERS)]
    row = np.searchsorted(at, place, side="right") - 1
    inside = place + _MARK <= at[row + 1]
    return place[inside], row[inside]


def _starts(begin: np.ndarray, sizes: np.ndarray, moved: np.ndarray, spm: np.ndarray) -> np.ndarray:
    """Where prefix, middle and suffix (columns) begin in outputs that begin at ``begin``."""
    prefix, _, suffix = sizes.T
    first = np.where(spm, suffix, prefix) + 2 * _MARK
    out = np.stack([np.where(spm, first, _MARK), prefix + suffix + 3 * _MARK, np.where(spm, _MARK, first)], axis=1)
    plain = np.stack([np.zeros_like(prefix), prefix, prefix + sizes[:, 1]], axis=1)
    return begin[:, None] + np.where(moved[:, None], out, plain)


def _shifts(size: int, place: np.ndarray, to: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of the texts, each with its bytes' places in the outputs. Pieces begin at ``place`` (ascending)."""
    change = np.diff(to - place, prepend=0)
    carried = 0
    for low in range(0, size, BLOCK):
        high = min(size, low + BLOCK)
        some = slice(*np.searchsorted(place, (low, high)))
        difference = np.zeros(high - low, dtype=np.int64)
        np.add.at(difference, place[some] - low, change[some])  # empty pieces begin where the next one does
        shift = carried + np.cumsum(difference)
        carried = shift[-1]
        yield slice(low, high), shift + np.arange(low, high)


def _chars(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[int]:
    return [int(np.count_nonzero((data[a:b] & 0xC0) != 0x80)) for a, b in zip(low, high)]


def scatter(data: np.ndarray, at: np.ndarray, cuts: np.ndarray, chosen: np.ndarray, spm: np.ndarray):
    """Outputs of texts (bytes and places), and their forms.

    ``cuts`` are two whole numbers of a text, taken modulo its lines + 1; ``chosen`` texts are transformed
    unless they are empty or hold a mark; ``spm`` tells the form. Gives (output bytes, their places, lines,
    moved, characters of the prefixes, of the middles).
    """
    begin, end = at[:-1], at[1:]
    ends = np.flatnonzero(data == ord("\n")) + 1
    first = np.searchsorted(ends, begin, side="right")
    closed = np.searchsorted(ends, end, side="right") - first
    open_ = (end > begin) & ~np.isin(end, ends)
    lines = closed + open_
    ends = np.append(ends, 0)

    def place(unit: np.ndarray) -> np.ndarray:
        line = ends[np.clip(first + unit - 1, 0, len(ends) - 1)]
        return np.where(unit == 0, begin, np.where(unit > closed, end, line))

    units = np.sort(cuts % (lines + 1)[:, None], axis=1)
    low, high = place(units[:, 0]), place(units[:, 1])
    moved = chosen & (end > begin)
    moved[_marks(data, at)[1]] = False
    sizes = np.stack([low - begin, high - low, end - high], axis=1)
    to = np.concatenate([[0], np.cumsum(end - begin + np.where(moved, 3 * _MARK, 0))])
    starts = _starts(to[:-1], sizes, moved, spm)
    out = np.empty(int(to[-1]), dtype=np.uint8)
    pieces = np.stack([begin, low, high], axis=1)
    for s, places in _shifts(len(data), pieces.ravel(), starts.ravel()):
        out[places] = data[s]
    for mark, where in zip((PREFIX, MIDDLE, SUFFIX), starts[moved].T):
        out[where[:, None] - _MARK + np.arange(_MARK)] = np.frombuffer(mark, dtype=np.uint8)
    prefix, middle = _chars(data, begin, low), _chars(data, low, high)
    return out, to, lines, moved, prefix, middle


def gather(data: np.ndarray, at: np.ndarray, moved: np.ndarray, spm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of outputs (bytes and places) whose forms are known."""
    begin, end = at[:-1], at[1:]
    place, row = _marks(data, at)
    place, row = place[moved[row]], row[moved[row]]
    if len(place) != 3 * moved.sum():
        raise ValueError("a transformed text holds each mark once")
    first, second, third = place.reshape(-1, 3).T
    left, right = second - first - _MARK, third - second - _MARK
    sizes = np.zeros((len(begin), 3), dtype=np.int64)
    sizes[:, 0] = end - begin
    sizes[moved, 0] = np.where(spm[moved], right, left)
    sizes[moved, 2] = np.where(spm[moved], left, right)
    sizes[moved, 1] = end[moved] - third - _MARK
    to = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])
    pieces = to[:-1, None] + np.concatenate([np.zeros((len(begin), 1), np.int64), np.cumsum(sizes, axis=1)[:, :2]], axis=1)
    out = np.empty(int(to[-1]), dtype=np.uint8)
    for s, places in _shifts(len(out), pieces.ravel(), _starts(begin, sizes, moved, spm).ravel()):
        out[s] = data[places]
    return out, to


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, id_: str = "doc_id",
              text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every text in its form; n are its lines."""
    prepared(docs.sparkSession)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_).cast("string"), F.lit(""))), 256)
    parts = [F.conv(F.substring("key", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    given = docs.select(F.col(id_).cast("long").alias("id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias(
        "t"), key.alias("key")).select("id", "t", parts[0].alias("a"), parts[1].alias("b"),
                                       (parts[2] % 100 < rate).alias("chosen"), (parts[3] % 100 < spm_rate).alias("spm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = _buffer(b.column(1))
            cuts = np.stack([np.asarray(b.column(2)), np.asarray(b.column(3))], axis=1)
            chosen, spm = (b.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            for s in _groups(at):
                own = at[s.start:s.stop + 1]
                out, to, lines, moved, prefix, middle = scatter(
                    data[own[0]:own[-1]], own - own[0], cuts[s], chosen[s], spm[s])
                form = np.where(moved, np.where(spm[s], SPM, PSM), PLAIN)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(s.start, s.stop - s.start), pa.array(lines, pa.int64()), pa.array(form, pa.string()),
                    pa.array(prefix, pa.int64(), mask=~moved), pa.array(middle, pa.int64(), mask=~moved),
                    _strings(out, to)], names=[c.split()[0] for c in _OUT.split(", ")])

    return given.mapInArrow(run, _OUT)


def restore(examples: DataFrame) -> DataFrame:
    """``examples`` (with form and output, as ``transform`` gives them) and their texts as ``restored``.

    A null form is plain, a null output empty.
    """
    names = examples.columns
    form_at, output_at = names.index("form"), names.index("output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = _buffer(b.column(output_at))
            forms = np.array(b.column(form_at).to_pylist(), dtype=object)
            for s in _groups(at):
                own = at[s.start:s.stop + 1]
                spm = forms[s] == SPM
                out, to = gather(data[own[0]:own[-1]], own - own[0], spm | (forms[s] == PSM), spm)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(s.start, s.stop - s.start) for c in b.columns), _strings(out, to)],
                    names=[*names, "restored"])

    return examples.mapInArrow(run, examples.withColumn("restored", F.lit("")).schema)
