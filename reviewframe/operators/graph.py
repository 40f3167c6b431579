"""Neighbourhood of changed definitions in the call graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions.once import computed


#: Seeds are walked in blocks of this many words of 64; a row of the frontier carries one block's bits.
WORDS = 2

#: The set bits of every byte.
BITS_OF = [[b for b in range(8) if byte >> b & 1] for byte in range(256)]


def _bits() -> list[str]:
    return [f"w{i}" for i in range(WORDS)]


def _numbered(seeds: DataFrame) -> DataFrame:
    """(graph_id, name, block, bit): distinct seeds, each with a place of its own in a block of its graph.

    A graph's seeds are dealt by hash into parts that fill four fifths of a block and numbered within a part,
    so a graph that owns most seeds is numbered by many tasks. A part that runs over opens another block.
    """
    roots = seeds.select("graph_id", "name").filter("graph_id IS NOT NULL AND name IS NOT NULL").distinct()
    parts = roots.groupBy("graph_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(51 * WORDS)).alias("parts"))
    dealt = roots.join(parts, "graph_id").select(
        "graph_id", "name", F.pmod(F.xxhash64("name"), F.col("parts")).alias("part"))
    at = F.row_number().over(Window.partitionBy("graph_id", "part").orderBy("name")) - 1
    return dealt.withColumn("at", at).select(
        "graph_id", "name", F.expr(f"shiftleft(part, 32) + at DIV {64 * WORDS}").alias("block"),
        F.expr(f"at % {64 * WORDS}").alias("bit"))


def _ways(edges: DataFrame, salts: int) -> dict[str, DataFrame]:
    """(graph_id, here, there) by direction, with a salt where there are several. Copies of an edge set the same bits."""
    pairs = edges.select("graph_id", "src", "dst").filter("src <> dst AND graph_id IS NOT NULL")
    ways = {"callee": pairs.select("graph_id", F.col("src").alias("here"), F.col("dst").alias("there")),
            "caller": pairs.select("graph_id", F.col("dst").alias("here"), F.col("src").alias("there"))}
    if salts == 1:
        return ways
    return {way: e.withColumn("salt", F.pmod(F.xxhash64("there"), F.lit(salts))) for way, e in ways.items()}


def _own_bits(numbered: DataFrame) -> DataFrame:
    """(graph_id, block, name, w0..): every seed with its own bit."""
    own = [F.expr(f"if(bit DIV 64 = {i}, shiftleft(1L, bit % 64), 0L)").alias(w) for i, w in enumerate(_bits())]
    return numbered.select("graph_id", "block", "name", *own)


def _walked(edges: DataFrame, numbered: DataFrame, max_depth: int, salts: int) -> dict[str, list[DataFrame]]:
    """For each direction and hop (graph_id, block, name, w0..): the seeds whose walks of that many steps end at a name.

    Walks of a block's seeds that meet at a name go on as one row, their bits joined by OR, so the rows that
    travel follow names and blocks, not seeds. A hub (a name everybody calls) may own a large share of the
    edges, so these are salted by their far end and the frontier, which is smaller, is repeated for every salt.
    The directions are walked apart: one that ends early moves nothing in later hops.
    """
    on = ["graph_id", "here"] + ["salt"] * (salts > 1)
    every_salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    walked = {}
    for way, steps in _ways(edges, salts).items():
        # Seeds are distinct, so a table of them is even and small beside the edges, which need no sorting for it.
        front, hops = _own_bits(numbered).hint("shuffle_hash"), []
        for _ in range(max_depth):
            spread = front.withColumnRenamed("name", "here")
            spread = spread.withColumn("salt", every_salt) if salts > 1 else spread
            front = (spread.join(steps, on).groupBy("graph_id", "block", F.col("there").alias("name"))
                     .agg(*[F.bit_or(w).alias(w) for w in _bits()]))
            hops.append(front)
        walked[way] = hops
    return walked


def seed_bits(edges: DataFrame, numbered: DataFrame, max_depth: int, salts: int) -> list[DataFrame]:
    """For each hop (graph_id, direction, block, name, w0..): the walks of both directions (``_walked``)."""
    walked = _walked(edges, numbered, max_depth, salts)
    both = zip(*[[h.withColumn("direction", F.lit(way)) for h in hops] for way, hops in walked.items()])
    return [reduce(DataFrame.unionByName, hop).select("graph_id", "direction", "block", "name", *_bits()) for hop in both]


def blast_radius(edges: DataFrame, seeds: DataFrame, max_depth: int = fx.BLAST_DEPTH,
                 salts: int = 1) -> DataFrame:
    """(graph_id, seed, name, direction, hops) within ``max_depth`` of each seed.

    Callees and callers are walked apart and never mixed; seeds outside the graph give nothing. The seeds
    of a graph are walked together, as bits (``seed_bits``); they become rows again only in the result,
    from one list of names a block. Nothing runs while the plan is built, and the hops share
    their exchanges. Large hubs are split by the adaptive planner; ``salts`` over 1 repeats the frontier
    for so many parts of every name's edges where that is not enough.
    """
    numbered = _numbered(seeds)
    key = ["graph_id", "block", "name"]
    # Each hop has its own words, so that one grouping in fixed columns brings a name's hops together. Hop 0 is
    # the seed itself, which no walk meets again.
    at = lambda hop, i: f"h{hop}w{i}"
    every = [(hop, i) for hop in range(1, max_depth + 1) for i in range(WORDS)]
    held = [(0, i) for i in range(WORDS)] + every
    # Dealt like the hops, whose grouping then needs no exchange of its own.
    start = _own_bits(numbered).repartition(*key)
    # What a hop meets first: its bits without those of the hops before.
    first = lambda hop, i: reduce(lambda seen, h: seen.bitwiseAND(F.bitwise_not(at(h, i))), range(hop), F.col(at(hop, i)))

    def fresh(way: str, hops: list[DataFrame]) -> DataFrame:
        worded = [h.select(*key, *[(F.col(f"w{i}") if hop == own else F.lit(None).cast("bigint")).alias(at(hop, i)) for hop, i in held])
                  for own, h in enumerate([start, *hops])]
        met = reduce(DataFrame.unionByName, worded).groupBy(*key).agg(
            *[F.coalesce(F.bit_or(at(hop, i)), F.lit(0).cast("bigint")).alias(at(hop, i)) for hop, i in held])
        return met.select(*key, F.lit(way).alias("direction"), *[first(hop, i).alias(at(hop, i)) for hop, i in every])

    walked = _walked(edges, numbered, max_depth, salts)
    both = reduce(DataFrame.unionByName, [fresh(way, hops) for way, hops in walked.items()])
    # A block holds at most 64 * WORDS seeds, so its list of names is bounded.
    names = numbered.groupBy("graph_id", "block").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("bit", "name"))), lambda s: s["name"]).alias("seeds"))
    # Word, byte, bit: three generators in compiled code, which pass over what is empty. Every block has its list:
    # the join is an outer one so that the planner leaves it out where nobody asks for the seed.
    keep = ["graph_id", "name", "direction", "seeds"]
    words = both.join(names, ["graph_id", "block"], "left").select(*keep, F.inline(F.array(*[F.struct(
        F.lit(hop).alias("hops"), F.lit(64 * i).alias("base"), F.col(at(hop, i)).alias("word")) for hop, i in every]))).filter("word <> 0")
    bytes_ = words.select(*keep, "hops", "base", F.posexplode(F.array(*[F.shiftrightunsigned("word", 8 * b).bitwiseAND(
        F.lit(255)).cast("int") for b in range(8)])).alias("place", "byte")).filter("byte <> 0")
    bits = bytes_.select(*keep, "hops", "base", "place", F.explode(F.get(F.lit(BITS_OF), "byte")).alias("bit"))
    return bits.select("graph_id", F.get("seeds", F.expr("base + 8 * place + bit")).alias("seed"), "name", "direction", "hops")


def blast_parts(radius: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(graph_id, name, part): defined neighbours that are not seeds themselves."""
    names = radius.select("graph_id", "name").distinct()
    outside = names.join(seeds.select("graph_id", "name"), ["graph_id", "name"], "left_anti")
    described = nodes.select("graph_id", "name", "content").filter(F.length("content") > 0)
    return outside.join(described, ["graph_id", "name"]).select(
        "graph_id", "name",
        F.concat(F.lit(fx.DEPENDENCY), "name", F.lit("\n"), "content").alias("part"))


def review_parts(radius: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(review_id, graph_id, name, part): what ``blast_parts`` gives, for each review's own seeds.

    ``seeds`` has review_id, graph_id and name.
    """
    own = seeds.select("review_id", "graph_id", "name").distinct()
    near = (radius.select("graph_id", "seed", "name")
            .join(own.withColumnRenamed("name", "seed"), ["graph_id", "seed"])
            .select("review_id", "graph_id", "name").distinct())
    outside = near.join(own, ["review_id", "graph_id", "name"], "left_anti")
    described = nodes.select("graph_id", "name", "content").filter(F.length("content") > 0)
    return outside.join(described, ["graph_id", "name"]).select(
        "review_id", "graph_id", "name",
        F.concat(F.lit(fx.DEPENDENCY), "name", F.lit("\n"), "content").alias("part"))


def _reached(rows: DataFrame, names: str, there: Callable[[Column], Column], found: str, max_depth: int) -> DataFrame:
    """Adds ``found``: names within ``max_depth`` steps of ``names``; each step is an array computed once."""
    keep = rows.columns
    empty = F.array().cast("array<string>")
    rows = computed(rows, keep, _front=F.col(names), _found=empty)
    for _ in range(max_depth):
        step = computed(rows, [*keep, "_front", "_found"], _step=there(F.col("_front")))
        rows = computed(step, keep, _front=F.array_except("_step", "_found"), _found=F.array_union("_found", "_step"))
    return rows.select(*keep, F.col("_found").alias(found))


def file_contexts(nodes: DataFrame, touched: DataFrame, max_depth: int = fx.BLAST_DEPTH) -> DataFrame:
    """(review_id, filename, name, part): definitions near the changed ones, in call graphs of one file each.

    A file's graph is one row, and so is its walk: what a seed calls or is called by, within ``max_depth``
    steps each, without further exchanges. ``touched`` has review_id, repo, ref, file_path and line_nums; a
    definition that holds such a line is a seed, and no seed is part of the context.
    """
    file = ["repo", "ref", "file_path"]
    # Dealt by file once; both groupings are satisfied by it.
    names = nodes.repartition(*file).groupBy(*file, "node_name").agg(
        F.max_by("content", F.struct("start_line", "end_line")).alias("content"),
        F.collect_list(F.struct("start_line", "end_line")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("dependencies"))).alias("calls"))
    graphs = names.groupBy(*file).agg(F.collect_list(F.struct("node_name", "content", "spans", "calls")).alias("graph"))
    rows = touched.select("review_id", *file, "line_nums").join(graphs, file)
    changed = F.filter("graph", lambda n: F.exists(n["spans"], lambda s: F.exists(
        "line_nums", lambda x: x.between(s["start_line"], s["end_line"]))))
    rows = computed(rows, ["review_id", "file_path", "graph"], seeds=F.transform(changed, lambda n: n["node_name"]))
    rows = rows.filter(F.size("seeds") > 0)
    rows = _reached(rows, "seeds", lambda front: F.array_distinct(F.flatten(F.transform(F.filter(
        "graph", lambda n: F.array_contains(front, n["node_name"])), lambda n: n["calls"]))), "down", max_depth)
    rows = _reached(rows, "seeds", lambda front: F.transform(F.filter(
        "graph", lambda n: F.arrays_overlap(n["calls"], front)), lambda n: n["node_name"]), "up", max_depth)
    near = computed(rows, ["review_id", "file_path", "graph"], near=F.array_except(F.array_union("down", "up"), "seeds"))
    found = near.select("review_id", F.col("file_path").alias("filename"), F.explode(F.filter(
        "graph", lambda n: F.array_contains(F.col("near"), n["node_name"]) & (F.length(n["content"]) > 0))).alias("n"))
    return found.select("review_id", "filename", F.col("n.node_name").alias("name"),
                        F.concat(F.lit(fx.DEPENDENCY), "n.node_name", F.lit("\n"), "n.content").alias("part"))


def blast_context(radius: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """One text per graph, neighbours in name order. ``blast_parts`` has them as rows."""
    parts = blast_parts(radius, nodes, seeds)
    ordered = F.array_sort(F.collect_list(F.struct("name", "part")))
    return parts.groupBy("graph_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["part"]), fx.BLOCK_SEPARATOR)
        .alias("context"))
