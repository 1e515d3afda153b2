"""Claimed dependencies against the code: one verdict a claim, and the real dependencies that nobody claimed.

Both are ordered first-match rules over frames that are joined beforehand; what is costly (paths) is joined only for the claims that still need it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import labels, paths
from lodestone.operators import graph
from lodestone.session import shuffled, stored

GATING = ("undocumented", "reversed", "phantom")
CHECKED = ("confirmed", "reversed", "phantom")


@dataclass(frozen=True)
class Settings:
    """Defaults of the checks."""

    max_depth: int = 3
    checkable: tuple[str, ...] = ("import", "function_call", "inheritance", "composition", "module")
    min_coverage: float = 0.8
    max_unresolved: float = 0.25
    hub_ratio: float = 0.5
    hub_min_nodes: int = 10
    min_imports: int = 3
    max_reported: int = 20
    covering_path: int = 3
    ignore_nodes: tuple[str, ...] = ()
    ignore_files: tuple[str, ...] = ("**/error.*", "**/errors.*", "**/config.*", "**/util.*", "**/utils.*", "**/utils/**", "**/types.*", "**/constants.*", "**/prelude.*")
    extra: dict = field(default_factory=dict)

    def merged(self, said: dict) -> Settings:
        """Over these, what a configuration says, held to sensible ranges."""
        held = {
            "max_depth": lambda v: max(1, int(v)), "min_imports": lambda v: max(1, int(v)),
            "min_coverage": lambda v: min(1.0, max(0.0, float(v))), "max_unresolved": lambda v: min(1.0, max(0.0, float(v))), "hub_ratio": lambda v: min(1.0, max(0.0, float(v))),
        }
        names = {f for f in self.__dataclass_fields__ if f != "extra"}
        known = {k: held.get(k, lambda v: tuple(v) if isinstance(v, list) else v)(v) for k, v in said.items() if k in names}
        return Settings(**{**{k: getattr(self, k) for k in names}, **known})


def normalized(claims: DataFrame, places: DataFrame, on_disk: DataFrame | None = None) -> DataFrame:
    """claims(ord, from, to, dependency_type, importance), places(path, ep) to the same with from_ep and to_ep (file, dir, empty, unknown): an endpoint is a
    place, or the tail of exactly one, or else exists although nothing of it was scanned. on_disk(path, ep): what exists."""
    raw = claims.select(F.explode(F.array("from", "to")).alias("raw")).distinct().withColumn("s", paths.normalized_claim(F.col("raw")))
    exact = places.groupBy(F.col("path").alias("s")).agg(F.max("ep").alias("ep")).withColumn("path", F.col("s"))  # file before dir
    told = stored(raw.join(shuffled(exact), "s", "left"))
    tail = graph.suffix_matches(told.where("path is null AND s <> ''").select("s").distinct(), places)
    told = told.join(shuffled(tail.select("s", F.col("path").alias("t_path"), F.col("ep").alias("t_ep"))), "s", "left")
    disk = F.lit(None).cast("string")
    if on_disk is not None:
        told = told.join(shuffled(on_disk.groupBy(F.col("path").alias("s")).agg(F.min("ep").alias("d_ep"))), "s", "left")  # dir before file
        disk = F.col("d_ep")
    plain = F.regexp_replace(F.regexp_replace("raw", r"^\s+|\s+$", ""), "^`+|`+$", "")
    node = F.coalesce("path", "t_path", F.when(disk.isNotNull() & (F.col("s") != ""), F.col("s")), plain)
    told = shuffled(stored(told.select("raw", node.alias("node"), F.when(F.col("s") == "", "empty").otherwise(F.coalesce("ep", "t_ep", disk, F.lit("unknown"))).alias("ep"))))
    out = claims.join(told.select(F.col("raw").alias("from"), F.col("node").alias("f"), F.col("ep").alias("from_ep")), "from")
    out = out.join(told.select(F.col("raw").alias("to"), F.col("node").alias("t"), F.col("ep").alias("to_ep")), "to")
    return out.select("ord", F.col("f").alias("from"), F.col("t").alias("to"), "from_ep", "to_ep", labels.dependency_type(F.col("dependency_type")).alias("kind"), F.least(F.greatest(F.col("importance").cast("int"), F.lit(0)), F.lit(255)).alias("importance"))


def deduped(claims: DataFrame) -> DataFrame:
    """One claim a pair: of the highest importance, its kind (the earliest of equals)."""
    best = F.max_by("kind", F.struct("importance", -F.col("ord")))
    return claims.groupBy("from", "to").agg(F.min("ord").alias("ord"), F.min_by("from_ep", "ord").alias("from_ep"), F.min_by("to_ep", "ord").alias("to_ep"), best.alias("kind"), F.max("importance").alias("importance"))


def claimed_nodes(claims: DataFrame) -> DataFrame:
    """node_id, ep of the endpoints that are places."""
    ends = claims.select(F.col("from").alias("node_id"), F.col("from_ep").alias("ep")).union(claims.select("to", "to_ep"))
    return ends.where("ep IN ('file', 'dir')").distinct()


def finding_id(cls: Column, a: Column, b: Column) -> Column:
    return F.concat(cls, F.lit(":"), a, F.lit("->"), b)


def classified(claims: DataFrame, counts: DataFrame, stats: DataFrame, g_all: DataFrame, g_full: DataFrame, hubs: DataFrame, edges: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """claims with class, reason, detail and evidence. counts(node_id, code, supported), stats(node_id, total, unresolved imports), edges: the tree's file edges."""
    some = edges.limit(1).agg((F.count("*") > 0).alias("has_edges"))
    end = lambda p: shuffled(counts.select(F.col("node_id").alias(p), F.col("code").alias(f"{p}_code"), F.col("supported").alias(f"{p}_sup")))
    rows = claims.join(end("from"), "from", "left").join(end("to"), "to", "left").join(shuffled(stats.select(F.col("node_id").alias("from"), "total", "unresolved")), "from", "left").crossJoin(F.broadcast(some))
    rows = rows.na.fill(0, ["from_code", "from_sup", "to_code", "to_sup", "total", "unresolved"])
    a, b = F.col("from"), F.col("to")

    def low(p: str) -> Column:
        return (F.col(f"{p}_code") > 0) & (F.col(f"{p}_sup") / F.col(f"{p}_code") < settings.min_coverage)

    def said(p: str) -> Column:
        return F.concat(F.lit(f"{p} endpoint '"), F.col(p), F.lit("'"))

    def short(p: str) -> Column:
        return F.concat(said(p), F.lit(": "), F.col(f"{p}_sup").cast("string"), F.lit("/"), F.col(f"{p}_code").cast("string"), F.lit(" files in supported languages"))

    none = F.lit(None).cast("string")
    verdict = lambda cls, reason, detail=none: F.struct(F.lit(cls).alias("class"), F.lit(reason).alias("reason"), detail.alias("detail"))
    drowned = (F.col("total") > 0) & (F.col("unresolved") / F.col("total") > settings.max_unresolved)
    early = (
        F.when((F.col("from_ep") == "empty") | (F.col("to_ep") == "empty"), verdict("unverifiable", "empty_endpoint"))
        .when((F.col("from_ep") == "unknown") | (F.col("to_ep") == "unknown"), verdict("unverifiable", "unknown_endpoint"))
        .when(a == b, verdict("structural", "self_loop"))
        .when((F.col("kind") == "data_flow") | ~F.col("kind").isin(*settings.checkable), verdict("unverifiable", "kind_not_checkable"))
        .when(F.col("from_code") == 0, verdict("unverifiable", "non_code_endpoint", F.concat(said("from"), F.lit(" has no scanned code files"))))
        .when(F.col("to_code") == 0, verdict("unverifiable", "non_code_endpoint", F.concat(said("to"), F.lit(" has no scanned code files"))))
        .when(low("from"), verdict("unverifiable", "language_coverage", short("from")))
        .when(low("to"), verdict("unverifiable", "language_coverage", short("to")))
        .when(drowned | ~F.col("has_edges"), verdict("unverifiable", "resolver_confidence", F.concat(F.col("unresolved").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" imports unresolved at source"))))
    )
    rows = rows.withColumn("early", early)
    every, full = graph.samples(g_all), stored(graph.samples(g_full))
    rows = rows.join(shuffled(every.select("from", "to", F.col("evidence").alias("ev_all"))), ["from", "to"], "left")
    rows = rows.join(shuffled(full.select("from", "to", F.col("evidence").alias("ev"))), ["from", "to"], "left")
    rows = rows.join(shuffled(full.select(F.col("to").alias("from"), F.col("from").alias("to"), F.col("evidence").alias("ev_back"))), ["from", "to"], "left")
    nested = paths.is_ancestor(a, b) | paths.is_ancestor(b, a)
    rows = stored(rows)
    wanted = rows.where(F.col("early").isNull() & ~nested & F.col("ev").isNull())
    via = graph.shortest_paths(g_full, wanted, hubs, settings.max_depth).select("from", "to", "path")
    rows = rows.join(shuffled(via), ["from", "to"], "left")
    late = (
        F.when(nested & F.col("ev_all").isNotNull(), verdict("confirmed", "containment"))
        .when(nested, verdict("structural", "containment"))
        .when(F.col("ev").isNotNull(), verdict("confirmed", "direct_evidence"))
        .when(F.col("path").isNotNull(), verdict("confirmed", "transitive", F.concat(F.lit("via "), F.array_join("path", " -> "))))
        .when(F.col("ev_back").isNotNull(), verdict("reversed", "reversed"))
        .otherwise(verdict("phantom", "phantom"))
    )
    rows = rows.withColumn("v", F.coalesce("early", late))
    proof = F.when(F.col("v.reason") == "containment", F.when(F.col("v.class") == "confirmed", F.col("ev_all"))).when(F.col("v.reason") == "direct_evidence", F.col("ev")).when(F.col("v.reason") == "reversed", F.col("ev_back"))
    proof = F.coalesce(proof, F.array().cast("array<struct<file:string,target:string,line:int>>"))
    return rows.select(finding_id(F.col("v.class"), a, b).alias("id"), F.col("v.class").alias("class"), "from", "to", "kind", "importance", F.col("v.reason").alias("reason"), F.col("v.detail").alias("detail"), proof.alias("evidence"))


def judged_edges(g_full: DataFrame, nodes: DataFrame, hubs: DataFrame, claims: DataFrame, distances: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every unclaimed edge between nodes with the first filter that drops it (null: reported), pairs and evidence. distances(from, to, hops) over the claims."""
    a, b = F.col("from"), F.col("to")
    strong = graph.strong(g_full)
    ignored = paths.matches_any(F.col("importer"), settings.ignore_files) | paths.matches_any(F.col("target"), settings.ignore_files)
    proof = strong.groupBy("from", "to").agg(F.count_distinct("importer", "target").alias("pairs"), F.bool_and(ignored).alias("all_ignored"))
    proof = proof.join(shuffled(graph.samples(strong)), ["from", "to"])
    shown = nodes.where("kind IN ('file', 'dir')").select("node_id")
    pairs = claims.select("from", "to").distinct()
    rows = g_full.select("from", "to").distinct().join(shuffled(pairs), ["from", "to"], "left_anti")
    for p in ("from", "to"):
        rows = rows.join(shuffled(shown.select(F.col("node_id").alias(p), F.lit(True).alias(f"{p}_shown"))), p, "left")
    rows = rows.join(shuffled(proof), ["from", "to"], "left").join(hubs.select(F.col("node_id").alias("to"), F.lit(True).alias("hub")), "to", "left")
    rows = rows.join(shuffled(pairs.select(F.col("to").alias("from"), F.col("from").alias("to"), F.lit(True).alias("back"))), ["from", "to"], "left")
    rows = rows.join(shuffled(distances.select("from", "to", "hops")), ["from", "to"], "left")
    listed = a.isin(*settings.ignore_nodes) | b.isin(*settings.ignore_nodes) if settings.ignore_nodes else F.lit(False)
    dropped = (
        F.when(F.col("from_shown").isNull() | F.col("to_shown").isNull(), "u1_unclaimed_end")
        .when(paths.is_ancestor(a, b) | paths.is_ancestor(b, a), "u2_containment")
        .when(F.col("pairs").isNull(), "u3_weak_evidence")
        .when(listed | F.col("all_ignored"), "u4_ignored")
        .when(F.col("hub").isNotNull(), "u5_hub_target")
        .when(F.col("back").isNotNull(), "u6_reverse_claimed")
        .when(F.col("hops") >= settings.covering_path, "u7_claimed_path")
        .when(F.col("pairs") < settings.min_imports, "u8_thin")
    )
    rows = rows.select("from", "to", "pairs", "evidence", dropped.alias("dropped"))
    rows = stored(rows)
    first = rows.where("dropped IS NULL").orderBy("from", "to").limit(settings.max_reported).select("from", "to", F.lit(True).alias("first"))  # the cap is the report's
    rows = rows.join(first, ["from", "to"], "left")
    return rows.select("from", "to", "pairs", "evidence", F.when(F.col("dropped").isNull() & F.col("first").isNull(), "u9_capped").otherwise(F.col("dropped")).alias("dropped"))


def undocumented(judged: DataFrame) -> DataFrame:
    """The reported edges as findings."""
    cls = F.lit("undocumented")
    detail = F.concat(F.col("pairs").cast("string"), F.lit(" import site(s)"))
    return judged.where("dropped IS NULL").select(finding_id(cls, F.col("from"), F.col("to")).alias("id"), cls.alias("class"), "from", "to", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("importance"), cls.alias("reason"), detail.alias("detail"), "evidence")


def filter_counts(judged: DataFrame) -> DataFrame:
    return judged.where("dropped IS NOT NULL").groupBy(F.col("dropped").alias("filter")).agg(F.count("*").alias("n"))


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("class").agg(F.count("*").alias("n"))


def reasons(findings: DataFrame) -> DataFrame:
    return findings.groupBy("class", "reason").agg(F.count("*").alias("n"))


def coverage(findings: DataFrame) -> DataFrame:
    """checked, total and their ratio, to four places."""
    out = findings.agg(F.count_if(F.col("class").isin(*CHECKED)).alias("checked"), F.count_if(F.col("class") != "undocumented").alias("total"))
    return out.withColumn("ratio", F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("checked") / F.col("total"), 4)))


def with_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """findings with in_baseline."""
    known = baseline.select(F.col("finding_id").alias("id"), F.lit(True).alias("known")).distinct()
    return findings.join(shuffled(known), "id", "left").withColumn("in_baseline", F.coalesce("known", F.lit(False))).drop("known")


def stale(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return baseline.select("finding_id").distinct().join(shuffled(findings.select(F.col("id").alias("finding_id"))), "finding_id", "left_anti")


def baseline_info(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """known, new (of all findings) and stale."""
    now = with_baseline(findings, baseline).agg(F.count_if("in_baseline").alias("known"), F.count_if(~F.col("in_baseline")).alias("new"))
    return now.crossJoin(stale(findings, baseline).agg(F.count("*").alias("stale")))


def new_baseline(findings: DataFrame) -> DataFrame:
    """The ids worth recording, in order."""
    return findings.where(F.col("class").isin(*GATING)).select(F.col("id").alias("finding_id")).distinct().orderBy("finding_id")


def strict_failures(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("class").isin("phantom", "reversed") & ~F.col("in_baseline"))


def node_stats(stats: DataFrame, file_node: DataFrame) -> DataFrame:
    """Imports and unresolved imports of each node's files."""
    return stats.join(shuffled(file_node.withColumnRenamed("file", "importer")), "importer").groupBy("node_id").agg(F.sum("total").alias("total"), F.sum("unresolved").alias("unresolved"))
