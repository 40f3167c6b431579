"""Source tree in, searchable chunks out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..operators.files import code_files
from ..operators.nodes import extract_nodes
from ..operators.vectors import admit_chunks, admit_files, drop_zero_vectors, embed_chunks


def build_index(tree: DataFrame, mode: str = "memory", max_files: int | None = None,
                max_file_chars: int | None = None, max_chunk_chars: int | None = None,
                **options) -> DataFrame:
    """Chunks with embeddings: source files, definitions, admission, encoding.

    ``memory`` embeds type and name with the text; ``table`` embeds the text only and drops chunks
    that got no vector. All files and whole texts are indexed unless a limit is given.
    """
    if mode == "memory":
        chosen = code_files(tree, fx.INDEX_EXTENSIONS_MEMORY, max_files)
    else:
        chosen = code_files(tree, fx.INDEX_EXTENSIONS_TABLE, max_files, max_file_chars)
    nodes = extract_nodes(admit_files(chosen, max_file_chars))
    chunks = embed_chunks(admit_chunks(nodes, mode, max_chunk_chars), mode, **options)
    if mode != "memory":
        chunks = drop_zero_vectors(chunks)
    identity = F.xxhash64("repo", "ref", "file_path", "start_line", "end_line", "node_name")
    return chunks.select("repo", identity.alias("chunk_id"), "file_path", "node_name",
                         "node_type", "content", F.lit("").alias("intent"), "embedding")
