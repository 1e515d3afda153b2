"""From file edges to the graph of claimed nodes: lift, facades, hubs, paths.

Relations: file_edges(importer, target, kind, test_only, line), file_node(file, node_id), nodes(node_id, kind), node_edges(from, to, importer, target,
kind, test_only, line) with one row for each piece of evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.session import shuffled, stored

STRONG = ("Import", "InlinePath", "ReExport")
FACADE_HOPS = 3


def suffix_matches(wanted: DataFrame, places: DataFrame) -> DataFrame:
    """wanted(s), places(path, ep) to s, path, ep where s is the tail of exactly one place; tails are exploded, so this is an equi-join."""
    tails = places.select("path", "ep", F.explode(paths.suffixes(F.col("path"))).alias("s")).join(shuffled(wanted.select("s").distinct()), "s", "left_semi")
    one = tails.groupBy("s").agg(F.count("*").alias("n"), F.min(F.struct("path", "ep")).alias("hit")).where("n = 1")
    return wanted.join(shuffled(one), "s").select("s", "hit.path", "hit.ep")


def deepest_ancestor(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """files(file), dirs(dir) to file, owner: the longest dir above the file."""
    above = files.select("file", F.posexplode(paths.ancestors(F.col("file"))).alias("depth", "dir"))
    return above.join(shuffled(dirs.distinct()), "dir").groupBy("file").agg(F.max_by("dir", "depth").alias("owner"))


def build_nodes(claimed: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """claimed(node_id, ep: file or dir), files(file, lang) to file_node, nodes(node_id, kind) and counts(node_id, code, supported).

    A file lifts to itself if claimed, else to its deepest claimed directory, else to a hidden node for its parent. It counts for that node and for every claimed
    directory above it.
    """
    kinds = stored(claimed.groupBy("node_id").agg(F.min(F.when(F.col("ep") == "dir", "dir").otherwise("file")).alias("kind")))
    dirs = kinds.where("kind = 'dir'").select(F.col("node_id").alias("dir"))
    own = files.join(shuffled(kinds.select(F.col("node_id").alias("file"), F.lit(True).alias("own"))), "file", "left")
    owner = own.join(shuffled(deepest_ancestor(files, dirs)), "file", "left")
    node = F.when(F.col("own"), F.col("file")).otherwise(F.coalesce("owner", paths.parent(F.col("file"))))
    placed = stored(owner.select("file", "lang", node.alias("node_id"), (F.col("own").isNull() & F.col("owner").isNull()).alias("hidden")))
    hidden = placed.where("hidden").select("node_id").distinct().join(shuffled(kinds), "node_id", "left_anti").select("node_id", F.lit("hidden").alias("kind"))
    above = placed.select("file", "lang", F.col("node_id").alias("owner"), F.explode(paths.ancestors(F.col("file"))).alias("dir"))
    above = above.join(shuffled(dirs), "dir").where("dir <> owner").select(F.col("dir").alias("node_id"), "lang")
    counted = placed.select("node_id", "lang").unionByName(above)
    counts = counted.groupBy("node_id").agg(F.count_if(paths.is_code(F.col("lang"))).alias("code"), F.count_if(paths.is_supported(F.col("lang"))).alias("supported"))
    return placed.select("file", "node_id"), kinds.unionByName(hidden), counts


def lift(edges: DataFrame, file_node: DataFrame, include_mod: bool = False) -> DataFrame:
    """Edges between nodes with their evidence, and what else an edge has; without loops, and module declarations only on request."""
    edges = edges if include_mod else edges.where("kind <> 'ModDecl'")
    near = file_node.select(F.col("file").alias("importer"), F.col("node_id").alias("from"))
    far = file_node.select(F.col("file").alias("target"), F.col("node_id").alias("to"))
    rows = edges.join(shuffled(near), "importer").join(shuffled(far), "target").where("`from` <> `to`")
    return rows.select("from", "to", "importer", "target", "kind", "test_only", "line", *(c for c in edges.columns if c not in ("importer", "target", "kind", "test_only", "line")))


def facade_closure(edges: DataFrame) -> DataFrame:
    """edges and, for each import of a facade file, Facade edges to what it re-exports over at most three hops; only facades lead on."""
    followed = edges.where(F.col("kind").isin("Import", "ReExport") & paths.is_facade(F.col("target")))
    start = followed.select("importer", "test_only", "line", F.col("target").alias("root"))
    again = edges.where("kind = 'ReExport'").select(F.col("importer").alias("at"), F.col("target").alias("next")).distinct()
    # a facade's closure depends on the facade alone, so it is found once for each
    layer = start.select("root").distinct().select("root", F.col("root").alias("at"))
    seen, found = layer.select("root", F.col("at").alias("next")), None
    for _ in range(FACADE_HOPS):
        new = layer.join(again, "at").select("root", "next").distinct().join(seen, ["root", "next"], "left_anti")
        found = new if found is None else found.unionByName(new)
        seen = seen.unionByName(new)
        layer = new.where(paths.is_facade(F.col("next"))).select("root", F.col("next").alias("at"))
    more = start.join(found, "root").where("next <> importer").select("importer", F.col("next").alias("target"), F.lit("Facade").alias("kind"), "test_only", "line")
    return edges.select("importer", "target", "kind", "test_only", "line").unionByName(more)


def strong(edges: DataFrame) -> DataFrame:
    """Evidence that is no test's, of the kinds that prove a dependency."""
    return edges.where(~F.col("test_only") & F.col("kind").isin(*STRONG))


def pair_counts(edges: DataFrame) -> DataFrame:
    """from, to, pairs: distinct importing and imported files."""
    return edges.groupBy("from", "to").agg(F.count_distinct("importer", "target").alias("pairs"))


def samples(edges: DataFrame, n: int = 3) -> DataFrame:
    """from, to, evidence: the first distinct (file, target, line)."""
    order = W.partitionBy("from", "to").orderBy("importer", "target", "line")
    first = edges.select("from", "to", "importer", "target", "line", F.dense_rank().over(order).alias("nth")).where(F.col("nth") <= n)
    each = F.struct(F.col("importer").alias("file"), "target", "line")
    return first.groupBy("from", "to").agg(F.array_sort(F.collect_set(each)).alias("evidence"))


def in_degrees(edges: DataFrame) -> DataFrame:
    """node_id, degree: distinct importing files, summed over the nodes they are in."""
    each = edges.groupBy("from", "to").agg(F.count_distinct("importer").alias("n"))
    return each.groupBy(F.col("to").alias("node_id")).agg(F.sum("n").alias("degree"))


def hubs(edges: DataFrame, nodes: DataFrame, ratio: float = 0.5, least: int = 10) -> DataFrame:
    """Nodes whose degree is at least ratio times the number of nodes, where there are enough of these."""
    total = nodes.agg(F.count("*").alias("total"))
    return in_degrees(edges).crossJoin(F.broadcast(total)).where((F.col("total") >= least) & (F.col("degree") >= F.col("total") * ratio)).select("node_id", "degree")


def shortest_paths(edges: DataFrame, wanted: DataFrame, blocked: DataFrame, depth: int = 3) -> DataFrame:
    """wanted(from, to) to the shortest path of at most depth hops, of equals the first in order; blocked(node_id) nodes only at its ends. A node reaches itself at once.

    A breadth-first search from each start: a layer has one row for a start and a node, with the first in order of its paths, as a later step does not depend on how the
    node was reached; a node that a start has reached before is dropped, as no shortest path comes back to it. The last hop comes from the other end: the nodes
    before each wanted end meet the layer, so nothing is expanded for it. A pair that is found leaves, and a start leaves with its last pair.
    """
    links = stored(edges.select(F.col("from").alias("at"), F.col("to").alias("next")).where("at <> next").distinct())
    open_ = links.join(shuffled(blocked.select(F.col("node_id").alias("next"))), "next", "left_anti").select("at", "next")
    before = links.withColumnRenamed("next", "to")
    pairs = stored(wanted.select("from", "to").distinct())
    found = pairs.where("`from` = `to`").withColumn("path", F.array("from"))
    left = pairs.where("`from` <> `to`")
    front = left.select("from", F.col("from").alias("at")).distinct().withColumn("path", F.array("from"))
    seen = front.select("from", "at")
    for hop in range(1, depth + 1):
        met = left.join(shuffled(before), "to").join(shuffled(front), ["from", "at"]).groupBy("from", "to").agg(F.min(F.array_append("path", F.col("to"))).alias("path"))
        if hop < depth:
            met = stored(met)
            left = stored(left.join(shuffled(met), ["from", "to"], "left_anti"))
            near = front.join(shuffled(left.select("from").distinct()), "from", "left_semi")
            grown = near.join(shuffled(open_), "at").groupBy("from", F.col("next").alias("at")).agg(F.min(F.array_append("path", F.col("next"))).alias("path"))
            front = stored(grown.join(shuffled(seen), ["from", "at"], "left_anti"))
            seen = seen.unionByName(front.select("from", "at"))
        found = found.unionByName(met)
    return found.select("from", "to", (F.size("path") - 1).alias("hops"), "path")


def shortest_distance(links: DataFrame, depth: int) -> DataFrame:
    """All pairs (from, to) and their distance, up to depth hops."""
    links = stored(links.select("from", "to").where("`from` <> `to`").distinct())
    reached = front = links.withColumn("hops", F.lit(1))
    step = links.select(F.col("from").alias("to"), F.col("to").alias("next"))
    for hop in range(2, depth + 1):
        front = front.join(shuffled(step), "to").select("from", F.col("next").alias("to")).where("`from` <> `to`").distinct()
        front = stored(front.join(shuffled(reached), ["from", "to"], "left_anti").withColumn("hops", F.lit(hop)))  # else each hop would run all before it again
        reached = reached.unionByName(front)
    return reached


def claim_distances(claims: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Pairs (from, to) and the distance at which a depth-first search that takes the last of a node's neighbours first discovers them. This is not
    always the shortest: distances are set on discovery. claims(from, to, and tree where there are several); starts(from, and tree): the nodes to search from, all by default.

    What each start reaches is found by joins, a hop at a time; then each (tree, start) has its own search over the neighbours of what it reaches, joined in as arrays. A task reads its
    starts sorted, one after the other, so it holds one search, not a tree. A start's rows are as many as its results.
    """
    own = ["tree"] if "tree" in claims.columns else []
    links = claims.select(*(own or [F.lit("").alias("tree")]), "from", "to").distinct()
    after = stored(links.groupBy("tree", F.col("from").alias("at")).agg(F.array_sort(F.collect_list("to")).alias("after")))
    if starts is None:
        begin = after.select("tree", F.col("at").alias("start"))
    else:
        begin = starts.select(*(own or [F.lit("").alias("tree")]), F.col("from").alias("start")).distinct()
    front = begin.withColumn("at", F.col("start"))
    reached = front.join(shuffled(after), ["tree", "at"], "left_semi").select("tree", "start", "at")
    front = reached = stored(reached)
    while True:
        new = front.join(shuffled(after), ["tree", "at"]).select("tree", "start", F.explode("after").alias("at")).distinct()
        front = stored(new.join(shuffled(reached), ["tree", "start", "at"], "left_anti"))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)

    def search(start: str, known: dict[str, list[str]]) -> dict[str, int]:
        seen, stack = {start: 0}, [start]
        while stack:
            at = stack.pop()
            for b in known.get(at, ()):
                if b not in seen:
                    seen[b] = seen[at] + 1
                    stack.append(b)
        return seen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known = None, {}

        def found() -> pa.RecordBatch:
            seen = search(key[1], known)
            columns = [pa.array([key[0]] * len(seen), pa.string()), pa.array([key[1]] * len(seen), pa.string()), pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["tree", "from", "to", "hops"])

        for batch in batches:
            out = []
            for tree, start, at, near in zip(*(batch.column(c).to_pylist() for c in ("tree", "start", "at", "after")), strict=True):
                if (tree, start) != key:
                    if key is not None:
                        out.append(found())
                    key, known = (tree, start), {}
                known[at] = near
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if key is not None:
            yield found()

    states = reached.join(shuffled(after), ["tree", "at"]).select("tree", "start", "at", "after")
    told = states.repartition("tree", "start").sortWithinPartitions("tree", "start").mapInArrow(run, "tree string, from string, to string, hops int")
    return told.select(*own, "from", "to", "hops")


def any_evidence(edges: DataFrame, importer: Column, target: Column) -> Column:
    """Whether an edge row joins these two files."""
    return F.bool_or((edges.importer == importer) & (edges.target == target))
