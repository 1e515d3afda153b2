"""Path expressions: everything here is a Column of built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File names whose imports are mostly re-exports.
FACADES = ("lib.rs", "mod.rs", "__init__.py", "index.js", "index.ts", "index.tsx", "index.jsx", "index.mjs", "index.cjs", "index.d.ts")

#: Extensions by language bucket.
LANGUAGES = {
    "rust": ("rs",),
    "python": ("py", "pyw", "pyi"),
    "js": ("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts", "vue", "svelte"),
    "unsupported": tuple("go java kt kts scala c h cpp cc cxx hpp cs rb php swift dart lua pl r jl m mm sh bash zsh sql graphql proto".split()),
}

#: What a file's extension adds to its importance.
EXTENSION_SCORES = {
    0.4: ("rs", "py", "java", "kt", "cpp", "c", "go", "rb", "php", "m", "swift", "dart", "cs"),
    0.3: ("sql", "sqlproj"),
    0.2: ("jsx", "tsx", "vue", "svelte", "csproj", "sln"),
    0.15: ("js", "ts", "mjs", "cjs", "gradle", "pom"),
    0.1: ("toml", "yaml", "yml", "json", "xml", "ini"),
    0.05: ("css", "scss", "sass", "less", "html", "htm"),
}


def display(path: Column) -> Column:
    """Backslashes to slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The directory of a path; '' at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """Lower-case extension; null where there is none (a leading dot starts none)."""
    name = base_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)))


def components(path: Column) -> Column:
    """Sorts as paths do: by component, so ``a/b`` comes before ``a-b/x``."""
    return F.split(path, "/")


def ancestors(path: Column) -> Column:
    """All proper ancestor directories, from the top; the root '' is first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def suffixes(path: Column) -> Column:
    """All proper component-aligned tails."""
    parts = F.split(path, "/")
    some = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    return F.when(F.size(parts) > 1, some).otherwise(F.array().cast("array<string>"))


def is_ancestor(a: Column, b: Column) -> Column:
    return (a != "") & F.startswith(b, F.concat(a, F.lit("/")))


def is_facade(path: Column) -> Column:
    return base_name(path).isin(*FACADES)


def language(ext: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, extensions in LANGUAGES.items():
        out = out.when(ext.isin(*extensions), name)
    return out.otherwise("other")


def is_code(lang: Column) -> Column:
    return lang != "other"


def is_supported(lang: Column) -> Column:
    return lang.isin("rust", "python", "js")


def importance(path: Column, size: Column, ext: Column) -> Column:
    """Additive score of a file, at most 1. Terms are added in a fixed order, as floating sums depend on it."""
    low = F.lower(path)
    has = lambda *words: F.lit(False) if not words else _any(low, words)
    points = F.when(F.lit(False), 0.0)
    for score, extensions in EXTENSION_SCORES.items():
        points = points.when(ext.isin(*extensions), score)
    score = F.lit(0.0)
    for term in (
        F.when(has("cmd", "internal", "pkg"), 0.3),
        F.when(has("main", "index"), 0.15),
        F.when(has("config", "setup"), 0.1),
        F.when((size > 1024) & (size < 50 * 1024), 0.15),
        points,
        F.when(has("database", "schema", "migrations"), 0.15),
    ):
        score = score + term.otherwise(0.0)
    return F.least(score, F.lit(1.0))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression of RE2's and Java's common part. ``*`` and ``?`` cross slashes, ``**/`` matches any directories or none."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append(".*")
            i += 1
        elif c == "?":
            out.append(".")
            i += 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"


def matches_any(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def normalized_claim(raw: Column) -> Column:
    """A claimed endpoint's text, cleaned: trimmed, without backticks, leading ``./``, trailing ``/`` and a `` (...)`` remark; '' means empty."""
    s = F.regexp_replace(raw, r"^\s+|\s+$", "")
    s = F.regexp_replace(F.regexp_replace(s, "^`+|`+$", ""), r"^\s+|\s+$", "")
    s = F.regexp_replace(F.regexp_replace(display(s), r"^(?:\./)+", ""), "/+$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s) \(.*$", ""), r"^\s+|\s+$", "")
    return F.when(s == ".", "").otherwise(s)


def lexical(path: Column) -> Column:
    """``.`` and ``..`` resolved by text alone; above the root ``..`` does nothing."""
    start = F.array().cast("array<string>")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    folded = F.aggregate(parts, start, lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.array_join(folded, "/")


def sanitized_name(name: Column) -> Column:
    """A name safe as a file's: reserved characters to hyphens, trimmed."""
    return F.regexp_replace(F.regexp_replace(name, r'[/\\:*?"<>|]', "-"), r"^\s+|\s+$", "")


def mermaid_id(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def capped(text: Column, n: int) -> Column:
    """The first n characters, marked where cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("\n[truncated]"))).otherwise(text)


def human_age(seconds: Column) -> Column:
    said = lambda by, unit: F.concat(F.floor(seconds / by).cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 120, said(1, "s")).when(seconds < 7200, said(60, "m")).when(seconds < 172_800, said(3600, "h")).otherwise(said(86_400, "d"))


def overlaps(a: Column, b: Column) -> Column:
    """Either contains the other."""
    return F.contains(a, b) | F.contains(b, a)


def rendered(template: str, values: dict[str, Column]) -> Column:
    """``{{name}}`` places filled in; unknown ones stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out
