"""Source files to definitions, and the call graph's edges and nodes."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import spread_join
from ..functions.once import computed
from ..functions.text import extension
from .diffs import changed_lines

_DEFINITIONS = {ast.FunctionDef: "function_definition",
                ast.AsyncFunctionDef: "function_definition",
                ast.ClassDef: "class_definition"}
# What a tree mostly consists of: values that hold no further nodes.
_LEAVES = frozenset([int, str, type(None), ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.Pass])
_EXTRACTED = pa.schema([
    ("repo", pa.string()), ("ref", pa.string()), ("file_path", pa.string()),
    ("node_type", pa.string()), ("node_name", pa.string()), ("content", pa.string()),
    ("start_line", pa.int32()), ("end_line", pa.int32()), ("dependencies", pa.list_(pa.string())),
    ("has_docstring", pa.bool_()), ("error", pa.string())])
_EXTRACTED_DDL = ("repo string, ref string, file_path string, node_type string, "
                  "node_name string, content string, start_line int, end_line int, "
                  "dependencies array<string>, has_docstring boolean, error string")
# Files are large, so they are taken up and definitions leave in small batches.
_FILES_IN, _ROWS_OUT = 32, 1000


def python_nodes(source: str) -> list[dict]:
    """Function and class definitions of one Python file, outer before inner."""
    tree = ast.parse(source)
    lines = source.encode("utf-8").splitlines(keepends=True)

    def text(node: ast.AST) -> str:
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            piece = lines[first][node.col_offset:node.end_col_offset]
        else:
            piece = b"".join([lines[first][node.col_offset:], *lines[first + 1:last],
                              lines[last][:node.end_col_offset]])
        return piece.decode("utf-8")

    found = []
    # One pass: every node carries the call sets of the definitions it lies in.
    pending: list[tuple[ast.AST, tuple[set, ...]]] = [(tree, ())]
    push = pending.append
    while pending:
        node, owners = pending.pop()
        kind = _DEFINITIONS.get(type(node))
        inside = owners
        if kind is not None:
            calls: set[str] = set()
            inside = (*owners, calls)
            found.append({"node_type": kind, "node_name": node.name, "content": text(node),
                          "start_line": node.lineno, "end_line": node.end_lineno,
                          "dependencies": calls,
                          "has_docstring": ast.get_docstring(node, clean=False) is not None})
        elif owners and type(node) is ast.Call:
            called = node.func
            if type(called) is ast.Name:
                name = called.id
            elif type(called) is ast.Attribute:
                name = text(called)
            else:
                name = None
            if name is not None:
                for calls in owners:
                    calls.add(name)
        for field, value in node.__dict__.items():
            if type(value) is list:
                # Decorators stand before the definition and are not part of it.
                scope = owners if field == "decorator_list" else inside
                for child in value:
                    if type(child) not in _LEAVES and isinstance(child, ast.AST):
                        push((child, scope))
            elif type(value) not in _LEAVES and isinstance(value, ast.AST):
                push((value, inside))
    for node in found:
        node["dependencies"] = sorted(node["dependencies"])
    found.sort(key=lambda n: (n["start_line"], -n["end_line"]))
    return found


EXTRACTORS: dict[str, Callable[[str], list[dict]]] = {"py": python_nodes}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    """Definitions as a batch, column by column: rows as such cost nearly as much to convert as files to parse."""
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _EXTRACTED],
                                      schema=_EXTRACTED)


def with_extractor(files: DataFrame, extractors: dict[str, Callable[[str], list[dict]]] = EXTRACTORS) -> DataFrame:
    """The files whose language is read; the others have no definitions."""
    return files.filter(extension(F.col("file_path")).isin(list(extractors)))


def _extract(files: DataFrame, extractors: dict[str, Callable[[str], list[dict]]]) -> DataFrame:
    def read(file: dict) -> list[dict]:
        base = {"repo": file["repo"], "ref": file["ref"], "file_path": file["file_path"]}
        try:
            return [{**base, **node} for node in extractors[file["ext"]](file["content"])]
        except Exception as e:  # one unreadable file must not fail the job
            return [{**base, "error": f"{type(e).__name__}: {e}"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.simplefilter("ignore", SyntaxWarning)
        rows: list[dict] = []
        for batch in batches:
            for at in range(0, batch.num_rows, _FILES_IN):
                for file in batch.slice(at, _FILES_IN).to_pylist():
                    rows.extend(read(file))
                    if len(rows) >= _ROWS_OUT:
                        yield _batch(rows)
                        rows = []
        yield _batch(rows)

    readable = (with_extractor(files, extractors).filter(F.length("content") > 0)
                .select("repo", "ref", "file_path", "content", extension(F.col("file_path")).alias("ext")))
    # Parsing costs far more than moving a file: spread the files evenly, whatever the layout of
    # the input, so that neither a big repo nor a single input split keeps one task busy.
    readable = readable.repartition("repo", "ref", "file_path")
    return readable.mapInArrow(run, _EXTRACTED_DDL)


def extract_nodes(files: DataFrame,
                  extractors: dict[str, Callable[[str], list[dict]]] = EXTRACTORS) -> DataFrame:
    """Definitions with span, text, called names and docstring flag; other languages give none."""
    return _extract(files, extractors).filter(F.col("error").isNull()).drop("error")


def quarantined_files(files: DataFrame,
                      extractors: dict[str, Callable[[str], list[dict]]] = EXTRACTORS) -> DataFrame:
    """Files the extractor could not read, with the reason."""
    return (_extract(files, extractors).filter(F.col("error").isNotNull())
            .select("repo", "ref", "file_path", "error"))


def changed_code(code: DataFrame, files: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """The source files that a review changes, each once: what has to be parsed for ``modified_nodes``.

    ``files`` has review_id and filename, one row or more for each changed file; without ``reviews`` it has
    repo, ref and file_path (``placed_files``).
    """
    file = ["repo", "ref", "file_path"]
    if reviews is None:
        return code.join(files.select(*file), file, "left_semi")
    changed = spread_join(files.select("review_id", F.col("filename").alias("file_path")),
                          reviews.select("review_id", "repo", "ref"), "review_id", "inner")
    return code.join(changed, file, "left_semi")


def placed_files(files: DataFrame, reviews: DataFrame) -> DataFrame:
    """(review_id, repo, ref, file_path, line_nums): changed files at their review's place, dealt by file once for several uses.

    Only files of a language that is read. Both sides of the exchange pass a generator: no use leaves a column out below
    it, and a ref the planner knows stays a key, so that what is dealt by repo, ref and path meets it as it lies.
    """
    file = ["repo", "ref", "file_path"]
    found = spread_join(files.select("review_id", F.col("filename").alias("file_path"), "line_nums"),
                        reviews.select("review_id", "repo", "ref"), "review_id", "inner")
    dealt = computed(found, [], **{c: F.col(c) for c in ("review_id", *file, "line_nums")}).repartition(*file)
    # The filter is what the planner would take over from the code into one use alone.
    return with_extractor(computed(dealt, file, review_id=F.col("review_id"), line_nums=F.col("line_nums")))


#: A file's changed lines travel in pieces of this many, found by the stretch of line numbers they answer for.
PIECE, STRETCH = 512, 2048


def _line_pieces(touched: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, _after, _nums, _stretch: sorted changed lines in pieces, each once for every stretch it answers for.

    A piece answers for the lines behind the piece before (``_after``) up to its own last one, so the first
    changed line at or below any line is in exactly one piece.
    """
    nums = F.array_sort(F.array_distinct(F.array_compact("line_nums")))
    file = computed(touched, keys, _all=nums).filter(F.size("_all") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / PIECE).cast("int"))
    pieces = file.select(*keys, F.inline(F.transform(starts, lambda i: F.struct(
        F.when(i == 0, F.lit(-1)).otherwise(F.get("_all", i * PIECE - 1)).alias("_after"),
        F.slice("_all", i * PIECE + 1, F.lit(PIECE)).alias("_nums")))))
    first, last = F.expr(f"(_after + 1) DIV {STRETCH}"), F.expr(f"element_at(_nums, -1) DIV {STRETCH}")
    return pieces.filter(last >= first).select("*", F.explode(F.sequence(first, last)).alias("_stretch"))


def modified_nodes(nodes: DataFrame, lines: DataFrame, reviews: DataFrame) -> DataFrame:
    """Definitions whose span holds an added line, once per review; nested ones both count.

    ``reviews`` maps review_id to (repo, ref). A definition meets the one piece of its file's changed lines
    that holds the first line at or below its start, so neither a long diff nor many definitions make the
    other dearer, and no later distinct is needed. Lines are counted from 0 up.
    ``start_added`` tells whether the definition's first line is an added one.
    """
    file = ["repo", "ref", "file_path"]
    touched = (spread_join(changed_lines(lines), reviews.select("review_id", "repo", "ref"), "review_id", "inner")
               .drop("_group").withColumnRenamed("filename", "file_path"))
    pieces = _line_pieces(touched, [*file, "review_id"])
    start = F.greatest("start_line", F.lit(0))
    answers = (start > F.col("_after")) & (start <= F.element_at("_nums", -1))
    inside = F.exists("_nums", lambda n: n.between(F.col("start_line"), F.col("end_line")))
    return (nodes.withColumn("_stretch", F.expr(f"greatest(start_line, 0) DIV {STRETCH}"))
            .join(pieces, [*file, "_stretch"]).filter(answers & inside)
            .withColumn("start_added", F.array_contains(F.col("_nums"), F.col("start_line")))
            .drop("_stretch", "_after", "_nums"))


def _graph_id(graph_keys: tuple[str, ...]):
    return F.concat_ws("@", *graph_keys).alias("graph_id")


def call_edges(nodes: DataFrame, graph_keys: tuple[str, ...] = ("repo", "ref")) -> DataFrame:
    """Distinct caller-callee pairs per graph; add ``file_path`` to the keys for per-file graphs."""
    pairs = nodes.select(_graph_id(graph_keys), F.col("node_name").alias("src"),
                         F.explode("dependencies").alias("dst"))
    return pairs.distinct().withColumn("type", F.lit("CALLS"))


def graph_nodes(nodes: DataFrame, edges: DataFrame,
                graph_keys: tuple[str, ...] = ("repo", "ref")) -> DataFrame:
    """One row per name: its last definition, or no attributes when it is only called."""
    defined = nodes.select(
        _graph_id(graph_keys), F.col("node_name").alias("name"),
        F.struct("file_path", "start_line", "end_line").alias("pos"),
        F.struct(F.col("node_type").alias("type"), "content", "start_line", "end_line")
        .alias("attr"))
    latest = defined.groupBy("graph_id", "name").agg(F.max_by("attr", "pos").alias("attr"))
    called = edges.select("graph_id", F.col("dst").alias("name")).distinct()
    return (latest.join(called, ["graph_id", "name"], "full_outer")
            .select("graph_id", "name", "attr.type", "attr.content", "attr.start_line",
                    "attr.end_line"))
