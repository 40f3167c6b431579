"""Chunk admission, embedding and exact nearest chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions.text import embed_text, search_result_block
from ..functions.vector import is_zero
from ..functions.windows import first_n

# Rows that meet in a task, at least: what travels for a query does not follow the size of a block.
CHUNK_TILE, QUERY_TILE = 20000, 16384
# Rows of a block: a task has one block of each side as numbers, and scores of a strip of queries.
CHUNK_BLOCK = 4096
QUERY_BLOCK = 4096
SCORE_CELLS = 1_000_000


# --- admission ---------------------------------------------------------------------------------
def admit_files(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    kept = files.filter(F.length("content") > 0)
    return kept if max_chars is None else kept.filter(F.length("content") <= max_chars)


def admit_chunks(nodes: DataFrame, mode: str = "memory", max_chars: int | None = None) -> DataFrame:
    """memory: over 100 characters, cut to ``max_chars``. table: non-empty, longer ones left out.

    Without ``max_chars`` every chunk stays whole.
    """
    size = F.length("content")
    if mode == "memory":
        kept = nodes.filter(size > fx.MIN_CHUNK_CHARS)
        return kept if max_chars is None else kept.withColumn(
            "content", F.substring("content", 1, max_chars))
    kept = nodes.filter(size > 0)
    return kept if max_chars is None else kept.filter(size <= max_chars)


def drop_zero_vectors(chunks: DataFrame) -> DataFrame:
    return chunks.filter(~is_zero(F.col("embedding")))


# --- embedding ---------------------------------------------------------------------------------
def tokens_of(text: Column) -> Column:
    """Lower-cased words and adjacent word pairs."""
    pack = F.array(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    return F.get(F.transform(pack, lambda words: F.concat(
        words, F.transform(F.slice(words, 2, 1 << 30),
                           lambda w, i: F.concat(F.get(words, i), F.lit(" "), w)))), F.lit(0))


def embed(df: DataFrame, text_col: str = "text", out_col: str = "embedding",
          encoder: Callable[[list[str]], np.ndarray] | None = None,
          width: int = fx.EMBED_WIDTH) -> DataFrame:
    """Adds an ARRAY<FLOAT> of ``width``; text that cannot be encoded gets the zero vector.

    The default encoder hashes words and word pairs on the JVM. A model plugs in as a function of a
    batch of texts, called on Arrow batches.
    """
    if encoder is None:
        words = df.withColumn("_tokens", tokens_of(F.coalesce(F.col(text_col), F.lit(""))))
        counted = HashingTF(numFeatures=width, inputCol="_tokens", outputCol="_tf").transform(words)
        scaled = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counted)
        return (scaled.withColumn(out_col, vector_to_array("_unit", "float32"))
                .drop("_tokens", "_tf", "_unit"))

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            try:
                rows = list(np.asarray(encoder(texts.fillna("").tolist()), dtype=np.float32))
            except Exception:
                rows = []
                for text in texts.fillna(""):
                    try:
                        rows.append(np.asarray(encoder([text]), dtype=np.float32)[0])
                    except Exception:
                        rows.append(np.zeros(width, dtype=np.float32))
            yield pd.Series(rows)

    return df.withColumn(out_col, encode(F.col(text_col)))


def embed_chunks(chunks: DataFrame, mode: str = "memory", **options) -> DataFrame:
    """Adds ``embedding``; the in-memory form embeds type and name too, the table form only text."""
    text = (embed_text(F.col("content"), F.col("node_type"), F.col("node_name"))
            if mode == "memory" else embed_text(F.col("content")))
    return embed(chunks.withColumn("_text", text), "_text", **options).drop("_text")


def embed_queries(queries: DataFrame, budget: int | None = None, **options) -> DataFrame:
    text = embed_text(F.col("query"), budget=budget)
    return embed(queries.withColumn("_text", text), "_text", **options).drop("_text")


# --- nearest chunks ----------------------------------------------------------------------------
def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows scaled to length 1; a zero row stays zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


_Hits = tuple[np.ndarray, np.ndarray, np.ndarray]  # query's position, id, score


def _first_k(hits: _Hits, k: int) -> _Hits:
    """The k best of each query: score down, then id up."""
    at, ids, scores = hits
    order = np.lexsort((ids, -scores, at))
    at = at[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return at[place < k], ids[order][place < k], scores[order][place < k]


def _joined(parts: list[_Hits]) -> _Hits:
    return tuple(np.concatenate(side) for side in zip(*parts))


def _best_per_query(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> _Hits:
    """Each query's k best rows; scores exist for a strip of queries at a time."""
    strip, found = max(1, SCORE_CELLS // max(1, len(ids))), []
    for start in range(0, len(queries), strip):
        # Rounded, so that ties do not depend on the shape of a block.
        scores = np.round(queries[start:start + strip] @ rows.T, 12)
        floor = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k, None] if len(ids) > k else -np.inf
        at, col = np.nonzero(scores >= floor)
        found.append(_first_k((at + start, ids[col], scores[at, col]), k))
    return _joined(found)


_HIT = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])
_HIT_DDL = "query_id bigint, chunk_id bigint, score double"


def _match_blocks(k: int, chunk_block: int, query_block: int):
    """One pair of tiles to its k hits per query, block by block."""

    def match(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        if queries.num_rows == 0 or chunks.num_rows == 0:
            return _HIT.empty_table()
        made = []
        for q in range(0, queries.num_rows, query_block):
            asked = queries.slice(q, query_block)
            vectors, held = _matrix(asked.column("embedding")), []
            for c in range(0, chunks.num_rows, chunk_block):
                met = chunks.slice(c, chunk_block)
                held.append(_best_per_query(vectors, _matrix(met.column("embedding")), met.column("chunk_id").to_numpy(), k))
                if len(held) > 16:
                    held = [_first_k(_joined(held), k)]
            at, ids, scores = _first_k(_joined(held), k)
            made.append(pa.RecordBatch.from_arrays(
                [pa.array(asked.column("query_id").to_numpy()[at]), pa.array(ids), pa.array(scores)], schema=_HIT))
        return pa.Table.from_batches(made)

    return match


def _block_hits(queries: DataFrame, chunks: DataFrame, k: int, chunk_block: int,
                query_block: int, one_owner: bool) -> DataFrame:
    """Both sides cut into tiles of bounded size, so a repo of any size spreads over many tasks."""
    chunk_tile, query_tile = max(CHUNK_TILE, chunk_block), max(QUERY_TILE, query_block)

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("by").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))

    if one_owner:  # all rows have the same key: two counts instead of a join on it
        shape = {name: F.lit(max(1, -(-df.count() // size))) for df, size, name in
                 ((chunks, chunk_tile, "nc"), (queries, query_tile, "nq"))}
        sized = lambda df: df.withColumns(shape)
    else:
        by_owner = blocks(chunks, chunk_tile, "nc").join(blocks(queries, query_tile, "nq"), "by")
        sized = lambda df: df.join(by_owner, "by")

    def place(df: DataFrame, key: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        return (sized(df)
                .withColumn(own, F.pmod(F.xxhash64(key), F.col(own_n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
                .select("by", "cb", "qb", key, "embedding"))

    left = place(queries, "query_id", "qb", "nq", "cb", "nc").groupBy("by", "cb", "qb")
    right = place(chunks, "chunk_id", "cb", "nc", "qb", "nq").groupBy("by", "cb", "qb")
    return left.cogroup(right).applyInArrow(_match_blocks(k, chunk_block, query_block), _HIT_DDL)


def knn(queries: DataFrame, chunks: DataFrame, k: int = fx.SEARCH_K, by: str | None = None,
        chunk_block: int = CHUNK_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Exact top ``k`` chunks per query by cosine score, ties by chunk id; ``by`` limits a query to
    chunks with the same value (the repo). Returns (query_id, chunk_id, score, rank).

    Both sides meet in tiles of bounded size, scored block by block. Pairs exist only inside a numpy block:
    a task hands on k hits per query. Chunks travel once for each tile of queries of their owner.
    """
    owner = (lambda df: F.col(by).cast("string")) if by else (lambda df: F.lit("*"))
    # Fresh aliases: both sides may come from one table.
    vec = F.col("embedding").alias("embedding")
    q = queries.select(F.col("query_id").alias("query_id"), owner(queries).alias("by"), vec).filter(
        F.col("by").isNotNull() & (F.size("embedding") > 0))
    c = chunks.select(F.col("chunk_id").alias("chunk_id"), owner(chunks).alias("by"), vec).filter(
        F.col("by").isNotNull() & (F.size("embedding") > 0))
    hits = _block_hits(q, c, k, chunk_block, query_block, by is None)
    return first_n(hits, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)


def search_text(hits: DataFrame, chunks: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One text per query over its ranked hits, as a search tool would answer.

    With ``queries`` (query_id, repo) a hit is a chunk of its query's repo: other repos may use the same id.
    """
    described = chunks.select("repo", "chunk_id", "file_path", "node_type", "node_name", "content")
    if queries is None:
        told = hits.join(described, "chunk_id")
    else:
        told = hits.join(queries.select("query_id", "repo").distinct(), "query_id").join(described, ["repo", "chunk_id"])
    block = search_result_block(F.col("file_path"), F.col("node_type"), F.col("node_name"),
                                F.col("score"), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return told.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["block"]), fx.BLOCK_SEPARATOR)
        .alias("result"))


def index_size(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repo").agg(F.count(F.lit(1)).alias("chunks"))
