"""The drift check from a tree's files and its claims to findings and the report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import drift, graph, resolve
from lodestone.session import kept


@dataclass
class Outcome:
    findings: DataFrame
    hubs: DataFrame
    filtered: DataFrame
    edges: DataFrame


def places(files: DataFrame) -> DataFrame:
    """path, ep: scanned files and the directories above them."""
    dirs = files.select(F.explode(paths.ancestors(F.col("rel_path"))).alias("path")).where("path <> ''").distinct()
    return files.select(F.col("rel_path").alias("path"), F.lit("file").alias("ep")).union(dirs.withColumn("ep", F.lit("dir")))


def file_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (facades followed) and import stats of a tree."""
    found = kept(resolve.imports(files, resolve.rust_crates(files)))
    told = kept(resolve.resolved(found, files))
    return graph.facade_closure(resolve.file_edges(told)), resolve.import_stats(told)


def analyze(files: DataFrame, claims: DataFrame, settings: drift.Settings | None = None, on_disk: DataFrame | None = None) -> Outcome:
    """files(rel_path, extension, content), claims(ord, from, to, dependency_type, importance), on_disk(path, ep): what exists beside the files scanned."""
    settings = settings or drift.Settings()
    edges, stats = file_graph(files)
    edges, stats = kept(edges), kept(stats)
    claimed = kept(drift.deduped(drift.normalized(claims, places(files), on_disk)))
    listed = files.select(F.col("rel_path").alias("file"), paths.language(F.col("extension")).alias("lang"))
    file_node, nodes, counts = map(kept, graph.build_nodes(drift.claimed_nodes(claimed), listed))
    g_all, g_full = kept(graph.lift(edges, file_node, True)), kept(graph.lift(edges, file_node))
    hubs = kept(graph.hubs(g_full, nodes, settings.hub_ratio, settings.hub_min_nodes))
    verdicts = drift.classified(claimed, counts, drift.node_stats(stats, file_node), g_all, g_full, hubs, edges, settings)
    judged = kept(drift.judged_edges(g_full, nodes, hubs, claimed, kept(graph.claim_distances(claimed)), settings))
    findings = kept(verdicts.unionByName(drift.undocumented(judged))).orderBy("id")
    return Outcome(findings, hubs, drift.filter_counts(judged), edges)
