"""The library's relations over the driver's tables, as frames and as SQL. They are synthetic.

Documents are files of a tree. Parts are files of another, whose directories and claims grow with them: each 400 parts are a module m{k}, in which part p lies in
d{b % 5}/s{b}_{k}, b = p % 40 (those of s15 in its utils). Each lineitem imports: its line number says from which directory to which and how, so all rows count and the graph of
directories has weak, thin, ignored, nested and missing edges, a hub that all modules import, and long paths. In each module, directories with b % 10 = 9
and s20 are claimed by nobody; files of s20 lift to d0, the others to hidden nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import drift, graph
from lodestone.plans import drift_check
from lodestone.session import read, stored

#: By line number, the directory that directory b imports; line 3 is of the first module.
_AHEAD = {1: "(l_partkey + 1) % 40", 2: "(l_partkey * 3 + 7) % 40", 3: "11", 4: "l_partkey % 40", 5: "(l_partkey + 5) % 40", 6: "(l_partkey + 2) % 40", 7: "(l_partkey * 7 + 3) % 40"}


def _module(key: str) -> str:
    return f"CAST(floor({key} / 400) AS BIGINT)"


def _node(b: str, k: str) -> str:
    return f"concat('m', {k}, CASE WHEN {b} = 20 THEN '/d0' ELSE concat('/d', {b} % 5, '/s', {b}, '_', {k}) END)"


def _path(key: str) -> str:
    return f"concat('m', {_module(key)}, '/d', {key} % 5, '/s', {key} % 40, '_', {_module(key)}, CASE WHEN {key} % 40 = 15 THEN '/utils' ELSE '' END, '/p', {key})"


def _group(key: str) -> str:
    return f"CAST(floor({key} / 40) AS BIGINT)"


def _rust_path(key: str) -> str:
    i, g = f"{key} % 40", _group(key)
    return f"""concat('k', {g}, '/', CASE WHEN {i} = 0 AND {g} % 4 = 0 THEN 'src/other.rs' WHEN {i} = 0 THEN 'src/lib.rs' WHEN {i} = 1 THEN 'src/main.rs' WHEN {i} < 10 THEN concat('src/m', {i}, '.rs')
        WHEN {i} < 18 THEN concat('src/m', {i} - 8, '/x', {i}, '.rs') WHEN {i} < 22 THEN concat('src/n', {i}, '/mod.rs') WHEN {i} < 30 THEN concat('src/n', 18 + {i} % 4, '/y', {i}, '.rs') WHEN {i} < 32 THEN concat('src/bin/b', {i}, '.rs')
        WHEN {i} < 34 THEN concat('tests/t', {i}, '.rs') WHEN {i} = 34 THEN 'examples/e.rs' WHEN {i} = 35 THEN 'build.rs' WHEN {i} = 36 THEN 'src/m2/x10/z.rs' WHEN {i} = 37 THEN 'src/bin/mod.rs'
        WHEN {i} = 38 THEN 'inner/src/lib.rs' WHEN {g} % 7 = 3 THEN 'inner/Cargo.toml' ELSE 'Cargo.toml' END)"""


#: The same relations in SQL, each a common table expression; ``with_views`` puts those that a query names in front of it.
SQL = {
    "files": """SELECT source || '/' || lang || '/doc_' || doc_id || '.' || CASE doc_id % 5 WHEN 0 THEN 'rs' WHEN 1 THEN 'py' WHEN 2 THEN 'ts' WHEN 3 THEN 'md' ELSE 'sql' END AS rel_path,
        source || '/' || lang AS dir, CASE doc_id % 5 WHEN 0 THEN 'rs' WHEN 1 THEN 'py' WHEN 2 THEN 'ts' WHEN 3 THEN 'md' ELSE 'sql' END AS extension, n_chars AS size, text AS content, doc_id FROM documents""",
    "listed": f"""SELECT {_path('p_partkey')} AS file, p_partkey % 40 AS b, {_module('p_partkey')} AS k, {_node('p_partkey % 40', _module('p_partkey'))} AS node_id,
        CASE WHEN p_partkey % 40 = 3 THEN 'other' WHEN p_partkey % 40 = 6 AND p_partkey // 40 % 2 = 0 THEN 'unsupported' ELSE 'rust' END AS lang FROM part""",
    "known": """SELECT DISTINCT array_to_string(string_split(file, '/')[:n], '/') AS node_id FROM listed, range(1, 6) r(n) WHERE n < len(string_split(file, '/'))""",
    "nodes": """SELECT node_id FROM listed UNION SELECT concat('m', k, '/d', b % 5) FROM listed WHERE b % 5 <> 4""",
    "file_node": """SELECT file, node_id FROM listed""",
    "file_edges": f"""SELECT {_path('i')} AS importer, {_path('t')} AS target, kind, test_only, line FROM (SELECT
        CASE WHEN l_linenumber = 3 THEN l_partkey ELSE 400 * {_module('l_partkey')} + CASE WHEN l_linenumber = 2 AND l_partkey % 8 = 1 THEN l_partkey % 40 + 40 ELSE l_partkey % 40 + 40 * (1 + l_suppkey % 2) END END AS i,
        CASE l_linenumber {' '.join(f'WHEN {n} THEN {t}' for n, t in _AHEAD.items())} END + 40 * CASE WHEN l_linenumber = 2 AND l_partkey % 8 = 1 THEN 1 ELSE 1 + l_suppkey % 3 END
          + CASE WHEN l_linenumber = 3 THEN 0 ELSE 400 * {_module('l_partkey')} END AS t,
        ['Import', 'InlinePath', 'Import', 'Import', 'ReExport', 'ModDecl', 'Import'][l_linenumber] AS kind, l_linenumber = 7 AS test_only, l_linenumber AS line FROM lineitem)""",
    "g_all": """SELECT a.node_id AS f, b.node_id AS t, importer, target, kind, test_only, line FROM file_edges JOIN file_node a ON a.file = importer JOIN file_node b ON b.file = target WHERE a.node_id <> b.node_id""",
    "g_full": """SELECT * FROM g_all WHERE kind <> 'ModDecl'""",
    "strong": """SELECT * FROM g_full WHERE NOT test_only AND kind IN ('Import', 'InlinePath', 'ReExport')""",
    "modules": """SELECT DISTINCT k FROM listed""",
    "claims": f"""SELECT {_node('a', 'k')} AS f, {_node('b', 'k')} AS t, CASE (a + b) % 6 WHEN 0 THEN 'import' WHEN 1 THEN 'function_call' WHEN 2 THEN 'inheritance' WHEN 3 THEN 'composition' WHEN 4 THEN 'data_flow' ELSE 'module' END AS kind,
        CAST(a * b % 5 + 1 AS INT) AS importance FROM modules, range(40) x(a) JOIN range(40) y(b) ON (a * 7 + b * 3) % 11 = 0 WHERE a % 10 <> 9 AND b % 10 <> 9 AND a <> 20 AND b <> 20
        UNION ALL SELECT concat('m', k, '/d', b % 5), {_node('b', 'k')}, 'module', 4 FROM modules, range(40) y(b) WHERE b % 5 <> 4 AND b <> 20 AND b // 5 % 2 = 1
        UNION ALL SELECT {_node('21', 'k')}, {_node('16', 'k')}, 'import', 3 FROM modules
        UNION ALL SELECT {_node('28', 'k')}, CASE WHEN {_node('23', 'k')} IN (SELECT node_id FROM known) THEN {_node('23', 'k')} ELSE concat('s23_', k) END, 'function_call', 2 FROM modules
        UNION ALL SELECT * FROM (VALUES ('', 'm0/d0', 'import', 1), ('nowhere/x', 'm0/d0', 'import', 2))""",
    "node_counts": """SELECT node_id, count(*) FILTER (WHERE lang <> 'other') AS code, count(*) FILTER (WHERE lang = 'rust') AS supported
        FROM (SELECT node_id, lang FROM listed UNION ALL SELECT concat('m', k, '/d', b % 5), lang FROM listed WHERE b % 5 <> 4 AND b <> 20) GROUP BY node_id""",
    "node_stats": """SELECT node_id, sum(b % 4 + 1) AS total, sum(CASE WHEN b % 8 = 3 THEN b % 4 + 1 ELSE 0 END) AS unresolved FROM listed GROUP BY node_id""",
    "degrees": """SELECT t AS node_id, sum(n) AS degree FROM (SELECT f, t, count(DISTINCT importer) AS n FROM g_full GROUP BY f, t) GROUP BY t""",
    "hubs": """SELECT node_id, degree FROM degrees WHERE degree >= 0.5 * (SELECT count(*) FROM nodes)""",
    "links": """SELECT DISTINCT f, t FROM g_full""",
    "open_links": """SELECT f, t FROM links WHERE t NOT IN (SELECT node_id FROM hubs)""",
    "walks": """SELECT f AS a, t AS b, [f, t] AS path FROM links
        UNION ALL SELECT x.f, y.t, [x.f, x.t, y.t] FROM open_links x JOIN links y ON x.t = y.f WHERE y.t <> x.f
        UNION ALL SELECT x.f, z.t, [x.f, x.t, y.t, z.t] FROM open_links x JOIN open_links y ON x.t = y.f JOIN links z ON y.t = z.f WHERE y.t <> x.f AND z.t NOT IN (x.f, x.t)""",
    "routes": """SELECT a, b, arg_min(path, {'n': len(path), 'p': path}) AS path FROM walks GROUP BY a, b""",
    "rust_files": f"""SELECT concat('t', {_group('p_partkey')} % 3) AS tree, {_rust_path('p_partkey')} AS file, {_group('p_partkey')} AS g, p_partkey % 40 AS i FROM part""",
    "rust_sources": """SELECT tree, file, string_split(file, '/') AS parts FROM rust_files WHERE i <> 39""",
    "manifests": """SELECT tree, dir, CASE WHEN g % 5 = 0 THEN string_split(dir, '/')[-1] ELSE 'pkg_' || g % 11 END AS package FROM (SELECT tree, g, regexp_replace(file, '/[^/]*$', '') AS dir FROM rust_files WHERE i = 39)""",
    "rust_near": """SELECT s.tree, file, parts, arg_max(dir, len(dir)) AS dir, arg_max(package, len(dir)) AS package FROM rust_sources s LEFT JOIN manifests m ON m.tree = s.tree AND starts_with(file, dir || '/') GROUP BY ALL""",
    "rust_inside": """SELECT *, parts[-1] AS name, array_to_string(parts[:-2], '/') AS home, CASE WHEN starts_with(file, dir || '/src/') THEN string_split(file[len(dir) + 6:], '/')[:-2] END AS inner_dirs FROM rust_near""",
    "rust_kinds": """SELECT *, inner_dirs IS NULL OR (inner_dirs = ['bin'] AND name <> 'mod.rs') AS apart, coalesce(name IN ('lib.rs', 'main.rs') AND len(inner_dirs) = 0, false) AS top, name IN ('lib.rs', 'main.rs', 'mod.rs') AS anchor, name[:-4] AS stem FROM rust_inside""",
    "rust_place": """SELECT tree, file, parts, coalesce(package, '') AS package, CASE WHEN apart THEN [] WHEN anchor THEN inner_dirs ELSE list_append(inner_dirs, stem) END AS module,
        CASE WHEN apart OR anchor THEN home ELSE home || '/' || stem END AS children, CASE WHEN apart OR top THEN file WHEN (k.tree, dir || '/src/lib.rs') IN (SELECT tree, file FROM rust_sources) THEN dir || '/src/lib.rs' ELSE dir || '/src/main.rs' END AS crate,
        CASE WHEN apart OR top THEN home ELSE dir || '/src' END AS base, CASE WHEN apart OR top THEN name = 'lib.rs' ELSE true END AS is_lib FROM rust_kinds k""",
    "rust_crate": """SELECT tree, crate, arg_min(package, parts) AS package, arg_min(base, parts) AS base, arg_min(is_lib, parts) AS is_lib, min(parts) AS first FROM rust_place GROUP BY tree, crate""",
    "rust_module": """SELECT p.tree, p.file, p.parts, c.package, p.crate, p.module, p.children, c.base, c.is_lib, c.first FROM rust_place p JOIN rust_crate c ON c.tree = p.tree AND c.crate = p.crate""",
    "rust_imports": f"""SELECT concat('t', {_group('l_partkey')} % 3) AS tree, {_rust_path('l_partkey')} AS importer, (l_orderkey * 8 + l_linenumber) * 100000 + l_suppkey AS seq,
        CASE l_linenumber WHEN 1 THEN 'crate' WHEN 2 THEN 'self' WHEN 3 THEN 'super' WHEN 7 THEN 'crate' ELSE 'named' END AS root, CASE WHEN l_linenumber = 3 THEN CAST(1 + s % 2 AS INT) ELSE 0 END AS levels,
        CASE WHEN l_linenumber IN (2, 3) AND s % 3 = 0 THEN ['tests'] ELSE [] END AS inline,
        CASE l_linenumber WHEN 1 THEN ['m' || 2 + s % 9, 'x' || 10 + s % 9, 'Item'] WHEN 2 THEN ['x' || 10 + s % 8] WHEN 3 THEN ['y' || 22 + s % 8, '*'] WHEN 4 THEN ['pkg_' || s % 13, 'm' || 2 + s % 8, 'x' || 10 + s % 8, 'self', 'no']
          WHEN 5 THEN ['m' || 2 + s % 8, 'T'] WHEN 6 THEN ['std', 'fs'] ELSE ['n' || 18 + s % 4, 'y' || 22 + s % 8, '*'] END AS segs FROM (SELECT *, l_suppkey AS s FROM lineitem) WHERE l_partkey % 40 <> 39""",
    "old_files": """SELECT rel_path AS path, CASE WHEN doc_id % 7 = 0 THEN sha256(content || '#') ELSE sha256(content) END AS hash FROM files WHERE doc_id % 10 <> 0""",
    "all_files": """SELECT rel_path AS path, sha256(content) AS hash FROM files""",
    "new_files": """SELECT rel_path AS path, sha256(content) AS hash FROM files WHERE doc_id % 11 <> 0""",
    "calls": """SELECT event_id, ts, 'a' || user_id % 7 AS agent, event_type AS status, value AS secs FROM events""",
}


def with_views(query: str) -> str:
    """query behind the expressions it needs, directly or through others."""
    import re

    wanted: list[str] = []

    def add(text: str) -> None:
        for name in SQL:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                add(SQL[name])
                if name not in wanted:
                    wanted.append(name)

    add(query)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    recursive = re.match(r"\s*WITH RECURSIVE\s", query)
    if recursive:
        return f"WITH RECURSIVE {head + ', ' if head else ''}{query[recursive.end():]}"
    again = re.match(r"\s*WITH\s", query)
    return f"WITH {head}, {query[again.end():]}" if again and head else f"WITH {head} {query}" if head else query


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.made: dict = {}

    def read(self, name: str) -> DataFrame:
        return read(self.spark, self.dir, name)

    def files(self) -> DataFrame:
        ext = F.element_at(F.array(*map(F.lit, ("rs", "py", "ts", "md", "sql"))), (F.col("doc_id") % 5 + 1).cast("int"))
        path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
        return self.read("documents").select(path.alias("rel_path"), ext.alias("extension"), F.col("n_chars").alias("size"), F.col("text").alias("content"), "doc_id")

    def listed(self) -> DataFrame:
        """file, lang of the parts' tree, and its imports as counted by a resolver."""
        b = F.col("p_partkey") % 40
        lang = F.when(b == 3, "other").when((b == 6) & (F.floor(F.col("p_partkey") / 40) % 2 == 0), "unsupported").otherwise("rust")
        lost = F.when(b % 8 == 3, b % 4 + 1).otherwise(0)
        return self.read("part").select(F.expr(_path("p_partkey")).alias("file"), lang.alias("lang"), (b % 4 + 1).alias("total"), lost.alias("unresolved"))

    def file_edges(self) -> DataFrame:
        """Each edge once with the number n of its lineitems, which repeat it about five times. They are counted by their numbers; texts are made of what is left."""
        if "file_edges" not in self.made:
            self.made["file_edges"] = stored(self._edge_texts(stored(self._edge_counts())))
        return self.made["file_edges"]

    def passing_edges(self) -> DataFrame:
        """The same, not stored, for a query that reads them once. Their ends are never null (of no file, if so), or a join's check for nulls would make the texts of every lineitem."""
        ends = {end: F.coalesce(end, F.lit("")) for end in ("importer", "target")}
        return self._edge_texts(self._edge_counts()).withColumns(ends)

    def edge_rows(self) -> DataFrame:
        """The edge of each lineitem by numbers: i and t, parts whose paths are its ends (a path ends in its part's number, so they stand for one another), and l_linenumber."""
        p, s, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
        thin, module = (line == 2) & (p % 8 == 1), 400 * F.expr(_module("l_partkey"))
        near = F.when(line == 3, p).otherwise(module + F.when(thin, p % 40 + 40).otherwise(p % 40 + 40 * (1 + s % 2)))
        ahead = F.when(F.lit(False), p)
        for n, to in _AHEAD.items():
            ahead = ahead.when(line == n, F.expr(to))
        far = ahead + 40 * F.when(thin, 1).otherwise(1 + s % 3) + F.when(line == 3, 0).otherwise(module)
        return self.read("lineitem").select(near.alias("i"), far.alias("t"), line.alias("l_linenumber"))

    def _edge_counts(self) -> DataFrame:
        return self.edge_rows().groupBy("i", "t", "l_linenumber").agg(F.count("*").alias("n"))

    def _edge_texts(self, counts: DataFrame) -> DataFrame:
        line = F.col("l_linenumber")
        kind = F.element_at(F.array(*map(F.lit, ("Import", "InlinePath", "Import", "Import", "ReExport", "ModDecl", "Import"))), line)
        return counts.select(F.expr(_path("i")).alias("importer"), F.expr(_path("t")).alias("target"), kind.alias("kind"), (line == 7).alias("test_only"), line.alias("line"), "n")

    def raw_claims(self) -> DataFrame:
        """ord, from, to, dependency_type, importance, with endpoints as people write them."""
        pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
        modules = self.read("part").select(F.expr(_module("p_partkey")).alias("k")).distinct()
        a, b, first = F.col("a"), F.col("b"), 10_000 * F.col("k")
        each = modules.select("k", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("b")).where("b % 10 <> 9 AND b <> 20")
        ends = [n for n in range(40) if n % 10 != 9 and n != 20]
        pairs = modules.select("k", F.explode(F.array(*(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")) for x in ends for y in ends if (x * 7 + y * 3) % 11 == 0))).alias("p")).select("k", "p.*")
        near = F.concat(pick(("`", "./", ""), a % 3), F.expr(_node("a", "k")), pick(("`", "", " (all)"), a % 3))
        kind = pick(("Import", "function call", "extends", "composition", "Data Flow", "owns"), (a + b) % 6)
        rows = pairs.select((first + a * 40 + b).alias("ord"), near.alias("from"), F.expr(_node("b", "k")).alias("to"), kind.alias("dependency_type"), (a * b % 5 + 1).cast("int").alias("importance"))
        nested = each.where("b % 5 <> 4 AND floor(b / 5) % 2 = 1").select(first + b + 2000, F.expr("concat('m', k, '/d', b % 5)"), F.expr(_node("b", "k")), F.lit("module"), F.lit(4))
        short = modules.select(first + 3002, F.expr(_node("21", "k")), F.expr(_node("16", "k")), F.lit("use"), F.lit(3)).union(
            modules.select(first + 3003, F.expr(_node("28", "k")), F.concat(F.lit("s23_"), F.col("k").cast("string")), F.lit("a call"), F.lit(2)))
        odd = self.spark.createDataFrame([(3000, "  ", "m0/d0", "import", 1), (3001, "nowhere/x", "m0/d0", "import", 2)], "ord long, from string, to string, dependency_type string, importance int")
        return rows.union(nested).union(short).union(odd)

    def claims(self) -> DataFrame:
        """As they are after normalising: each endpoint a place of the tree, or empty or unknown."""
        if "claims" not in self.made:
            places = drift_check.places(self.listed().select(F.col("file").alias("rel_path")))
            self.made["claims"] = stored(drift.deduped(drift.normalized(stored(self.raw_claims()), places)))
        return self.made["claims"]

    def built(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """file_node, nodes and counts of the claimed tree, as the drift check builds them."""
        if "built" not in self.made:
            self.made["built"] = tuple(map(stored, graph.build_nodes(drift.claimed_nodes(self.claims()), self.listed().select("file", "lang"))))
        return self.made["built"]

    def file_node(self) -> DataFrame:
        """The same file_node by its rule, for queries that need no claims."""
        return self.read("part").select(F.expr(_path("p_partkey")).alias("file"), F.expr(_node("p_partkey % 40", _module("p_partkey"))).alias("node_id"))

    def nodes(self) -> DataFrame:
        tops = self.read("part").where("p_partkey % 5 <> 4").select(F.expr(f"concat('m', {_module('p_partkey')}, '/d', p_partkey % 5)").alias("node_id"))
        return self.file_node().select("node_id").union(tops).distinct()

    def node_stats(self) -> DataFrame:
        return drift.node_stats(self.listed().select(F.col("file").alias("importer"), "total", "unresolved"), self.built()[0])

    def old_files(self) -> DataFrame:
        text = F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("#"))).otherwise(F.col("content"))
        return self.files().where("doc_id % 10 <> 0").select(F.col("rel_path").alias("path"), F.sha2(text, 256).alias("hash"))

    def all_files(self) -> DataFrame:
        return self.files().select(F.col("rel_path").alias("path"), F.sha2("content", 256).alias("hash"))

    def new_files(self) -> DataFrame:
        return self.files().where("doc_id % 11 <> 0").select(F.col("rel_path").alias("path"), F.sha2("content", 256).alias("hash"))

    def rust_files(self) -> DataFrame:
        """Trees of Rust packages, 40 parts each, some without a manifest of their own, some with one name: tree, rel_path, content."""
        g = F.expr(_group("p_partkey"))
        name = F.when(g % 5 == 0, F.lit("version = '1'")).otherwise(F.concat(F.lit('name = "pkg-'), (g % 11).cast("string"), F.lit('"')))
        content = F.when(F.col("p_partkey") % 40 == 39, F.concat(F.lit("[package]\n"), name, F.lit("\n[dependencies]\nname = 'x'\n")))
        return self.read("part").select(F.concat(F.lit("t"), (g % 3).cast("string")).alias("tree"), F.expr(_rust_path("p_partkey")).alias("rel_path"), content.alias("content"))

    def rust_imports(self) -> DataFrame:
        """A lineitem is an import of its part's file; its line number says where the path begins."""
        s, line = F.col("l_suppkey"), F.col("l_linenumber")
        rows = self.read("lineitem").where("l_partkey % 40 <> 39")  # those are manifests, which import nothing
        # repeats are dropped by numbers: of the supplier, only what the line's path depends on
        part = F.when(line == 1, s % 9).when(line.isin(2, 3), s % 24).when(line == 4, s % 104).when(line == 6, 0).otherwise(s % 8)
        rows = stored(rows.select("l_partkey", ((F.col("l_orderkey") * 8 + line) * 100000 + s).alias("seq"), "l_linenumber", part.alias("l_suppkey")).distinct())
        name = lambda head, n: F.concat(F.lit(head), n.cast("string"))
        lit = lambda *words: F.array(*map(F.lit, words))
        m, x, y = name("m", 2 + s % 8), name("x", 10 + s % 8), name("y", 22 + s % 8)
        segs = (
            F.when(line == 1, F.array(name("m", 2 + s % 9), name("x", 10 + s % 9), F.lit("Item"))).when(line == 2, F.array(x)).when(line == 3, F.array(y, F.lit("*")))
            .when(line == 4, F.array(name("pkg_", s % 13), m, x, F.lit("self"), F.lit("no"))).when(line == 5, F.array(m, F.lit("T"))).when(line == 6, lit("std", "fs")).otherwise(F.array(name("n", 18 + s % 4), y, F.lit("*")))
        )
        root = F.when(line.isin(1, 7), "crate").when(line == 2, "self").when(line == 3, "super").otherwise("named")
        inline = F.when(line.isin(2, 3) & (s % 3 == 0), lit("tests")).otherwise(F.array().cast("array<string>"))
        return rows.select(F.concat(F.lit("t"), (F.expr(_group("l_partkey")) % 3).cast("string")).alias("tree"), F.expr(_rust_path("l_partkey")).alias("importer"), "seq",
            F.lit("rust").alias("lang"), root.alias("root"), F.when(line == 3, (1 + s % 2).cast("int")).otherwise(0).alias("levels"), inline.alias("inline"), segs.alias("segs"))

    def calls(self) -> DataFrame:
        return self.read("events").select("event_id", "ts", F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string")).alias("agent"), F.col("event_type").alias("status"), F.col("value").alias("secs"))
