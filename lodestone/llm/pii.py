r"""Personal data by fixed patterns and by bootstrapped contextual extraction, in DataFrame functions only.

Base entities (email, ip, card, phone) come from patterns over whole texts. They are the seeds: the words before a seed are a lexical pattern, every
identifier-shaped run of tokens (one that holds a digit or @) with words before it is an instance, and the two form a graph. Each round scores
patterns (the share of their distinct instances' scores, of a kind with at least SUPPORT instances already trusted) and then instances (the best of their
patterns); instances of patterns of at least TRUST whose shape suits the kind become spans of that kind, and feed the next round's patterns.
Base spans always stay; a discovered span never overlaps one.

The patterns match as their plain forms do, written so that no long run of characters is scanned twice and no group recurses:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    card   [0-9]([\x20-]?[0-9])+, 13 to 19 digits passing Luhn
    phone  \+[0-9][\x20().0-9-]+[0-9], 9 to 15 digits

Cases: a null text is empty (redacted it stays null); rows that repeat a key each get their spans; null keys stay; empty tables give empty results; redaction keeps all
columns, whatever their names. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._base import cut, picked, prepared

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A run of tokens that looks like an identifier, and further groups of digits after single spaces.
SHAPED = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [(]?[0-9][0-9().-]*+)*+"
#: What a discovered identifier of a kind must look like.
SHAPES = {"email": r"^\S+(?:@|\[at\]|\(at\))\S+$", "ip": r"^[0-9A-Fa-f]+(?:[.:][0-9A-Fa-f]*){3,}$", "card": r"^(?:[^0-9]*[0-9]){12,19}[^0-9]*$", "phone": r"^[+(]?(?:[ ().-]*[0-9]){7,15}$"}
#: Characters before an instance that may hold its pattern's words, and the words.
CONTEXT, LEFT = 60, r"(\S+\s+\S+)\s*$"
SUPPORT, TRUST, ROUNDS = 3, 0.7, 3
#: Numbers folded at a time, and characters of a piece in which places are found.
BLOCK, PIECE = 256, 512
FAR = 2**31 - 1
#: So many texts with discovered spans or fewer are broadcast (under 100 MB); more are joined by shuffle.
BROADCAST_TEXTS = 100_000


def running(df: DataFrame, **of: tuple[str, int, str]) -> DataFrame:
    """df with, by name=(values, zero, step): for each of an array of ints the fold (step: an associative expression of {} and x) of those before it. An array that grows is
    copied at each step, so folds run inside blocks of BLOCK, over the blocks' results, and on from these: n * BLOCK / 2 + (n / BLOCK) ** 2 / 2 numbers are copied."""

    def folded(values: str, start: str, step: str) -> str:
        return f"aggregate({values}, struct({start} AS at, CAST(array() AS array<int>) AS out), (acc, x) -> struct({step.format('acc.at')} AS at, concat(acc.out, array(acc.at)) AS out), acc -> acc.out)"

    cut_up = "CASE WHEN size(_v_{0}) > 0 THEN transform(sequence(0, CAST((size(_v_{0}) - 1) DIV {1} AS INT)), i -> slice(_v_{0}, i * {1} + 1, {1})) ELSE array() END"
    df = df.withColumns({f"_v_{n}": F.expr(values) for n, (values, _, _) in of.items()})
    df = df.withColumns({f"_b_{n}": F.expr(cut_up.format(n, BLOCK)) for n in of})
    df = df.withColumns({f"_h_{n}": F.expr(folded(f"transform(_b_{n}, b -> aggregate(b, {zero}, (a, x) -> {step.format('a')}))", str(zero), step)) for n, (_, zero, step) in of.items()})
    return df.withColumns({n: F.expr(f"flatten(zip_with(_b_{n}, _h_{n}, (b, h) -> {folded('b', 'h', step)}))") for n, (_, _, step) in of.items()})


def matches(df: DataFrame, text: str, **patterns: tuple[str, str]) -> DataFrame:
    """df with, by name=(pattern, hint): the leftmost non-overlapping matches in the column text, an array of start, end, value, before (the CONTEXT characters ahead).
    hint: a character that every match holds, or nothing."""
    pairs = "filter(zip_with(split({0}, {1}, -1), regexp_extract_all({0}, {1}, 0), (g, m) -> struct(length(g) AS gap, m AS value, right(g, {2}) AS before)), p -> p.value IS NOT NULL)"
    found = {}
    for name, (pattern, hint) in patterns.items():
        there = F.expr(f"contains({text}, '{hint}') AND {text} RLIKE r'{pattern}'")
        found[f"_p_{name}"] = F.when(there, F.expr(pairs.format(text, f"r'{pattern}'", CONTEXT))).otherwise(F.expr("CAST(array() AS array<struct<gap:int,value:string,before:string>>)"))
    df = running(df.withColumns(found), **{f"_a_{n}": (f"transform(_p_{n}, p -> p.gap + length(p.value))", 0, "{} + x") for n in patterns})
    placed = "zip_with(_p_{0}, _a_{0}, (p, at) -> struct(at + p.gap AS start, at + p.gap + length(p.value) AS end, p.value AS value, p.before AS before))"
    return df.withColumns({n: F.expr(placed.format(n)) for n in patterns})


def luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def base(df: DataFrame, text: str, **more: tuple[str, str]) -> DataFrame:
    """df with the base entities of each kind in a column of its name, and the matches of more patterns."""
    part = "(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
    df = matches(df, text, _ip=(IP, "."), _card=(CARD, ""), _phone=(PHONE, "+"), email=(EMAIL, "@"), **more)
    digits = lambda m: F.length(F.regexp_replace(m["value"], "[^0-9]", ""))
    return df.withColumns({
        "ip": F.filter("_ip", lambda m: m["value"].rlike(rf"^{part}\.{part}\.{part}\.{part}$")),
        "card": F.filter("_card", lambda m: luhn(m["value"])),
        "phone": F.filter("_phone", lambda m: digits(m).between(9, 15)),
    })


def _written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _named(kind: str) -> Column:
    """The matches in the column of a kind, with the kind ahead."""
    return F.transform(F.col(kind), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), m["before"].alias("before")))


def _flat() -> Column:
    """All base spans by kind as listed, then start: kind, start, end, value, before."""
    return F.concat(*map(_named, KINDS))


def _only(spans: Column, kind: str) -> Column:
    return F.array_sort(F.filter(spans, lambda s: s["kind"] == kind))


def _instances(df: DataFrame) -> DataFrame:
    """df with ``others``: the identifier-shaped runs in ``shaped`` outside the base spans in ``spans``, trimmed of brackets, quotes and closing points."""
    lead, tail = r"^[<(\[{\"']*+", r"[>)\]}\"',;.!?]*$"

    def trimmed(m: Column) -> Column:
        inner = F.regexp_replace(m["value"], lead, "")
        return F.struct((m["end"] - F.length(inner)).alias("start"), F.regexp_replace(inner, tail, "").alias("value"), m["before"].alias("before"))

    looks = "|".join(f"(?:{x})" for x in SHAPES.values())
    df = df.withColumn("_own", F.filter(F.transform("shaped", trimmed), lambda m: F.length(m["value"]).between(5, 64) & m["value"].rlike(looks)))
    # by start, base spans first of equals; where there is nothing to keep out, none
    df = df.withColumn("_both", F.expr("""array_sort(concat(
        transform(CASE WHEN size(_own) > 0 THEN spans ELSE slice(spans, 1, 0) END, s -> struct(s.start AS start, false AS other, s.end AS end, '' AS value, '' AS before)),
        transform(_own, m -> struct(m.start AS start, true AS other, m.start + length(m.value) AS end, m.value AS value, m.before AS before))))"""))
    # an instance stays that no span ahead of it reaches into and that ends before the next one
    df = running(df, _reach=("transform(_both, m -> CASE WHEN m.other THEN 0 ELSE m.end END)", 0, "greatest({}, x)"),
                 _next=(f"reverse(transform(_both, m -> CASE WHEN m.other THEN {FAR} ELSE m.start END))", FAR, "least({}, x)"))
    return df.withColumn("_next", F.reverse("_next")).withColumn("others", F.expr("""transform(
        filter(arrays_zip(_both, _reach, _next), r -> r._both.other AND r._reach <= r._both.start AND r._next >= r._both.end),
        r -> struct(r._both.start AS start, r._both.end AS end, r._both.value AS value, r._both.before AS before))"""))


def found(docs: DataFrame, key: str | None = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key (null where none is named), _text_hash, the kinds' base entities, spans (base) and others (instances not in them), computed once."""
    prepared(docs.sparkSession)
    rows = picked(docs, text=text).withColumn("key", F.lit(None).cast("long")) if key is None else picked(docs, key=key, text=text)
    rows = rows.select("key", F.coalesce("text", F.lit("")).alias("_text"))
    rows = base(rows.select("key", F.md5("_text").alias("_text_hash"), "_text"), "_text", shaped=(SHAPED, ""))
    rows = _instances(rows.withColumn("spans", _flat()))
    return cut(rows.select("key", "_text_hash", *(F.size(k).cast("long").alias(k) for k in KINDS), "spans", "others"))


def discovered(rows: DataFrame) -> DataFrame:
    """From found(): one row a text with discovered spans: _text_hash, more (array of kind, start, end, value)."""
    left = F.lower(F.regexp_extract("before", LEFT, 1))
    seeds = rows.select(F.explode("spans").alias("s")).select(F.col("s.before").alias("before"), F.col("s.value").alias("value"), F.col("s.kind").alias("kind"))
    plain = rows.select(F.explode("others").alias("s")).select(F.col("s.before").alias("before"), F.col("s.value").alias("value"), F.lit("").alias("kind"))
    edges = cut(seeds.union(plain).select(left.alias("left"), "value", "kind").where("left <> ''").distinct())
    sizes = cut(edges.groupBy("left").agg(F.count_distinct("value").alias("n")))
    trusted = cut(edges.where("kind <> ''").select("value", "kind").distinct().withColumn("score", F.lit(1.0)))
    suits = F.lit(False)
    for kind, shape in SHAPES.items():
        suits = suits | ((F.col("kind") == kind) & F.col("value").rlike(shape))
    unknown, count = edges.where("kind = ''").select("left", "value"), -1
    scores = None
    for _ in range(ROUNDS):
        mass = edges.select("left", "value").distinct().join(trusted, "value").groupBy("left", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("support"))
        patterns = cut(mass.where(F.col("support") >= SUPPORT).join(sizes, "left").select("left", "kind", (F.col("mass") / (F.col("n") + 1)).alias("trust")).where(F.col("trust") >= TRUST))
        scores = unknown.join(patterns, "left").where(suits).groupBy("value").agg(F.max(F.struct("trust", "kind")).alias("best"))
        scores = cut(scores.select("value", F.col("best.kind").alias("kind"), F.col("best.trust").alias("score")))
        now = scores.count()
        if now == count:
            break
        count = now
        trusted = trusted.where("score = 1.0").union(scores)
    taken = rows.select("_text_hash", "others").dropDuplicates(["_text_hash"]).select("_text_hash", F.explode("others").alias("s")).select("_text_hash", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"), F.lower(F.regexp_extract("s.before", LEFT, 1)).alias("left"))
    taken = taken.join(scores.select("value", "kind"), "value").join(patterns, ["left", "kind"], "left_semi")
    return cut(taken.groupBy("_text_hash").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "value"))).alias("more")))


def _joined(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows with ``more`` by _text_hash (null where a text has none)."""
    few = more.count() <= BROADCAST_TEXTS
    return rows.join(F.broadcast(more) if few else more, "_text_hash", "left")


def entities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_email, n_ip, n_card, n_phone (base), base (array of kind, start, end, value), discovered (the same, of the method), all (both, by kind and start)."""
    rows = found(docs, key, text)
    out = _joined(rows, discovered(rows))
    cutdown = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    more = F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>"))
    out = out.select(F.col("key").alias(key), *(F.col(k).alias(f"n_{k}") for k in KINDS), cutdown.alias("base"), more.alias("discovered"))
    order = F.concat(*(_only(F.concat("base", "discovered"), k) for k in KINDS))
    return out.withColumn("all", order)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    out = entities(docs, key, text)
    return out.select(key, *(f"n_{k}" for k in KINDS), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("all")).alias("spans"))


def _replaced(df: DataFrame, text: str, spans: str) -> DataFrame:
    """df with ``_new``: the column text with its spans (start, end, kind; by start) as kinds in angle brackets; a span that begins inside those before it adds nothing.
    The text is read in pieces of PIECE characters, as the place of a character in a long string is found by counting from its start."""

    def part(a: str, b: str) -> str:
        low = f"greatest({a} - i * {PIECE}, 0)"
        return f"CASE WHEN {b} > {a} THEN array_join(transform(sequence(CAST({a} DIV {PIECE} AS INT), CAST(({b} - 1) DIV {PIECE} AS INT)), i -> substring(_pieces[i], {low} + 1, least({b} - i * {PIECE}, {PIECE}) - {low})), '') ELSE '' END"

    df = df.withColumn("_pieces", F.expr(f"CASE WHEN size({spans}) > 0 THEN regexp_extract_all({text}, r'(?s).{{1,{PIECE}}}', 0) END"))
    df = df.withColumn("_far", F.expr(f"coalesce(array_max(transform({spans}, s -> s.end)), 0)")).withColumn("_long", F.length(text))
    df = running(df, _reach=(f"transform({spans}, s -> s.end)", 0, "greatest({}, x)"))
    told = f"zip_with({spans}, _reach, (s, at) -> CASE WHEN s.start >= at THEN concat({part('at', 's.start')}, '<', upper(s.kind), '>') ELSE '' END)"
    return df.withColumn("_new", F.expr(f"CASE WHEN size({spans}) > 0 THEN concat(array_join({told}, ''), {part('_far', '_long')}) END"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span (base and discovered) in text replaced by its kind in angle brackets; overlapping spans become one. The patterns run once to learn the contexts
    and once to replace, as moving the texts to their spans would cost more."""
    more = discovered(found(docs, None, text))
    names = docs.columns
    at = names.index(text)
    inner = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("_text", F.coalesce(f"c{at}", F.lit("")))
    inner = _joined(base(inner.withColumn("_text_hash", F.md5("_text")), "_text"), more)
    thin = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.array_sort(F.concat(thin(_flat()), F.coalesce(thin(F.col("more")), F.array().cast("array<struct<start:int,end:int,kind:string>>"))))
    inner = _replaced(inner.withColumn("_all", spans), "_text", "_all")
    new = F.coalesce("_new", F.col(f"c{at}"))
    return inner.select(*((new if i == at else F.col(f"c{i}")).alias(f"c{i}") for i in range(len(names)))).toDF(*names)
