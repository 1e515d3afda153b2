"""Insights into files by directory: dossiers, top-k picks and the text blocks made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import labels, paths
from lodestone.operators import substrings
from lodestone.session import kept

#: Caps on blocks, in rows and characters.
INSIGHTS, KEY_MODULE, DATABASE, README_CHARS, SUMMARY_CHARS, MATERIAL_CHARS = 25, 50, 50, 16_384, 10_240, 192_000
BOUNDARY = ("Entry", "Api", "Config", "Router", "Controller", "Command")


def directories(files: DataFrame) -> DataFrame:
    """dir, n_files, bytes and subdirectories (of those that hold files) of files(rel_path, size)."""
    own = files.groupBy(paths.parent(F.col("rel_path")).alias("dir")).agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))
    above = own.where("dir <> ''").groupBy(paths.parent(F.col("dir")).alias("dir")).agg(F.count("*").alias("subdirectories"))
    return own.join(above, "dir", "left").na.fill(0, ["subdirectories"])


def histogram(files: DataFrame) -> DataFrame:
    return files.where("extension IS NOT NULL").groupBy("extension").agg(F.count("*").alias("n"))


def grouped(files: DataFrame) -> DataFrame:
    """dir and its files, best first, as an array."""
    each = F.struct((-F.col("importance_score")).alias("rank"), paths.components(F.col("rel_path")).alias("order"), "rel_path", "size")
    listed = F.transform(F.array_sort(F.collect_list(each)), lambda f: F.struct(f["rel_path"].alias("rel_path"), f["size"].alias("size")))
    return files.groupBy(paths.parent(F.col("rel_path")).alias("dir")).agg(listed.alias("files"))


def by_importance(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("importance_score"), paths.components(F.col("rel_path")))


def readme(files: DataFrame) -> DataFrame:
    """The best root file whose name begins with readme."""
    root = files.where(~F.contains("rel_path", F.lit("/")) & F.lower("name").startswith("readme"))
    return by_importance(root).limit(1)


def dossiers(dirs: DataFrame, answers: DataFrame) -> DataFrame:
    """Directory facts and a reply's insights; an insight without a path gets its directory's. dirs(dir, name), answers(dir, insights array of name, file_path, ...)."""
    full = F.transform("insights", lambda i: i.withField("file_path", F.when(F.coalesce(i["file_path"], F.lit("")) == "", F.concat_ws("/", F.nullif("dir", F.lit("")), i["name"])).otherwise(i["file_path"])))
    return dirs.join(answers, "dir").withColumn("purpose", labels.directory_purpose(F.col("name"))).withColumn("insights", full)


def top(insights: DataFrame, n: int = INSIGHTS, where: Column | None = None) -> DataFrame:
    """The n most important insights; of equals, in order of directory and place. insights(dir, idx, importance_score, ...)."""
    rows = insights if where is None else insights.where(where)
    return rows.orderBy(F.desc("importance_score"), "dir", "idx").limit(n)


def boundary(insights: DataFrame, n: int = INSIGHTS) -> DataFrame:
    return top(insights, n, F.col("purpose").isin(*BOUNDARY))


def database(insights: DataFrame) -> DataFrame:
    """Of database purposes. A file counts by its extension only if its whole last component is that extension, which files never are."""
    return top(insights, DATABASE, F.col("purpose").isin("Database", "Dao") | paths.base_name(F.col("file_path")).isin(".sql", ".sqlproj"))


def key_module(insights: DataFrame, code_paths: DataFrame) -> DataFrame:
    """Insights whose path contains, or is contained in, one of code_paths(code_path)."""
    near = substrings.overlapping(insights.select("file_path"), code_paths.select("code_path")).select(F.col("a").alias("file_path")).distinct()
    return top(insights.join(near, "file_path", "left_semi"), KEY_MODULE)


def interfaces(insights: DataFrame, n: int = 10) -> DataFrame:
    """dir and the first n interface names of its insights, in order. insights(dir, idx, interfaces array of name)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "interfaces"))), lambda i: F.transform(i["interfaces"], lambda x: x["name"]))
    return insights.groupBy("dir").agg(F.slice(F.flatten(ordered), 1, n).alias("names"))


def within(rows: DataFrame, line: Column, budget: int, *order: Column) -> DataFrame:
    """The lines that begin before ``budget`` characters of all lines (each with its line end) in order: place, line (the last one cut).

    Ranges of the order are sorted and summed by themselves; only the ranges' totals meet. A range's lines beyond the budget go before that, so what is left
    holds ``budget`` characters at most.
    """
    keyed = rows.select(*(k.alias(f"o{i}") for i, k in enumerate(order)), F.concat(line, F.lit("\n")).alias("line"))
    named = [f"o{i}" for i in range(len(order))]
    keyed = kept(keyed).repartitionByRange(*named, "line").sortWithinPartitions(*named, "line")
    keyed = keyed.select("line", F.length("line").alias("n"), F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("place"))
    own = W.partitionBy("pid").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    summed = kept(keyed.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0))).where(F.col("before") < budget))
    totals = summed.groupBy("pid").agg(F.max(F.col("before") + F.col("n")).alias("n"))  # at least the budget where lines were dropped
    ahead = totals.select("pid", F.coalesce(F.sum("n").over(W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    left = F.lit(budget) - F.col("ahead") - F.col("before")
    return summed.join(ahead, "pid").where(left > 0).select("place", F.substring("line", F.lit(1), F.least(F.col("n"), left).cast("int")).alias("line"))


def block(rows: DataFrame, title: str, line: Column, *order: Column, budget: int = MATERIAL_CHARS) -> DataFrame:
    """One text: a title and a fenced line for each row, in order, cut at ``budget`` characters."""
    head, foot = f"{title}\n```markdown\n", "```\n"
    lines = within(rows, line, max(0, budget - len(head)), *order)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "")
    return lines.agg(F.substring(F.concat(F.lit(head), joined, F.lit(foot)), 1, budget).alias("text"))


def fan_in(results: DataFrame) -> DataFrame:
    """A fan-out's results(key, value, ord) as one map in order of key; of a key given twice the last value stays."""
    last = results.groupBy("key").agg(F.max_by("value", "ord").alias("value"))
    return last.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("results"))


def fan_out(dirs: DataFrame, agent: str) -> DataFrame:
    """An instance for each directory or domain: name and target."""
    return dirs.select(F.concat(F.lit(f"{agent}@"), "key").alias("name"), F.col("key").alias("target"))


def own_domain(domains: Column, name: Column) -> Column:
    """A domain's own entry and the names of the others, of an array of structs with a name."""
    own = F.filter(domains, lambda d: d["name"] == name)
    return F.struct(F.get(own, F.lit(0)).alias("domain"), F.transform(F.filter(domains, lambda d: d["name"] != name), lambda d: d["name"]).alias("other_domains"))


def topo_levels(deps: dict[str, list[str]]) -> list[list[str]]:
    """levels() of a handful of names at hand, level by level. Raises on a cycle."""
    left, found = {k: {d for d in v if d in deps} for k, v in deps.items()}, []
    while left:
        ready = [k for k, v in left.items() if not v]
        if not ready:
            raise ValueError(f"cycle among {sorted(left)}")
        found.append(ready)
        left = {k: v - set(ready) for k, v in left.items() if k not in ready}
    return found


def levels(names: DataFrame, needs: DataFrame) -> DataFrame:
    """names(name), needs(name, need) to name, level (0 for what needs nothing, else after all it needs) and cyclic. What needs a cycle, or lies on one, has no level; only
    what lies on one (or between two) is cyclic. Needs that are no names count as met.

    Names are peeled a level at a time by the number of their unmet needs; then what is left is peeled from the other end. The steps are as many as the levels.
    """
    names = kept(names.select("name").distinct())
    links = kept(needs.select("name", "need").distinct().join(names, "name", "left_semi").join(names.withColumnRenamed("name", "need"), "need", "left_semi"))

    def peeled(left: DataFrame, links: DataFrame, name: str, need: str) -> tuple[DataFrame | None, DataFrame]:
        degree = links.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
        left, found, level = kept(left.join(degree, "name", "left").na.fill(0, ["n"])), None, 0
        while True:
            ready = left.where("n = 0").select("name")
            if ready.isEmpty():
                return found, left.select("name")
            found = ready.withColumn("level", F.lit(level)) if found is None else found.unionByName(ready.withColumn("level", F.lit(level)))
            met = links.join(ready.withColumnRenamed("name", need), need).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("met"))
            left = kept(left.where("n > 0").join(met, "name", "left").select("name", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n")))
            level += 1

    found, left = peeled(names, links, "name", "need")
    inner = links.join(left, "name", "left_semi").join(left.withColumnRenamed("name", "need"), "need", "left_semi")
    _, cyclic = peeled(left, kept(inner), "need", "name")
    rest = left.join(cyclic.withColumn("cyclic", F.lit(True)), "name", "left").select("name", F.lit(None).cast("int").alias("level"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    return rest if found is None else found.withColumn("cyclic", F.lit(False)).unionByName(rest)


def tree_lines(listed: DataFrame, files: bool = True) -> DataFrame:
    """listed(path), all files or all directories, drawn as a tree: path, line and order (sorts the lines), for each path and all directories above.

    In a directory the last entry is the greatest, so whether a line's branches go on is a grouped maximum and a join on each of its ancestors. Directories come before files.
    """
    parts = F.split("path", "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), (n == F.size(parts)).alias("end")))
    nodes = listed.select("path").distinct().select(F.explode(each).alias("n")).groupBy("n.path").agg(F.bool_and("n.end").alias("leaf"))
    leaf = F.col("leaf") if files else F.lit(False)
    nodes = kept(nodes.select("path", leaf.alias("leaf"), paths.parent(F.col("path")).alias("home"), paths.base_name(F.col("path")).alias("name")))
    last = nodes.groupBy("home").agg(F.max(F.struct("leaf", "name")).alias("last"))
    nodes = nodes.join(last, "home").select("path", "leaf", "name", (F.struct("leaf", "name") == F.col("last")).alias("final"))
    above = nodes.select("path", F.posexplode(F.slice(paths.ancestors(F.col("path")), 2, 1 << 20)).alias("depth", "dir"))
    ends = above.join(nodes.select(F.col("path").alias("dir"), F.col("final").alias("over")), "dir").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("depth", "over"))).alias("ends"))
    ahead = F.array_join(F.transform(F.coalesce("ends", F.array().cast("array<struct<depth:int,over:boolean>>")), lambda e: F.when(e["over"], "    ").otherwise("│   ")), "")
    line = F.concat(ahead, F.when(F.col("final"), "└── ").otherwise("├── "), "name", F.when(F.col("leaf"), "").otherwise("/"))
    own = F.split("path", "/")
    order = F.transform(own, lambda part, i: F.struct((F.col("leaf") & (i == F.size(own) - 1)).alias("leaf"), part.alias("name")))
    return nodes.join(ends, "path", "left").select("path", line.alias("line"), order.alias("order"))
