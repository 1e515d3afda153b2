"""Mixing sources to target weights by Pareto order sampling.

Within a source the words to take are ``ratio * size`` for every document: ``floor(ratio)`` whole copies are certain, and
the fraction is the document's inclusion probability (unequal between sources). Documents are ranked by their random
odds divided by their inclusion odds; the sample is fixed in size, counted in words: going down that order, each document is taken that still
fits into what is left of the target. This is done in runs: a run takes, of the documents no larger than what is left at its start, the longest stretch that
fits; the next run goes on behind the document that did not fit, until what is left is under a thousandth of the target or no document
fits any more. Random numbers are hashes of the id, so reruns agree.

Cases: null or empty texts have size 0; a null source is a source of its own, last in order; a null id ranks as any other
value; rows that repeat an id rank each by itself, by the id, the whole row and a number among equal rows, so a part of them can be taken (which of equal rows makes no difference); a source without
words has target 0 and nothing of it is taken; an empty table gives an empty result. Other columns of the input stay as they are in ``mixed`` and are dropped in ``decided``; where ids repeat they must be of types
that can be grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm._base import cut, partition_offsets, picked, prepared, word_count

#: Bits of the order's value that one step of the search for a run's end reads, and the steps.
BITS, STEPS = 12, 3
#: The gap (as a share of the target) that needs no further run.
NEAR = 0.001
#: Equal rows that are numbered at a time.
PLACES = 1 << 16
#: Ids that repeat are broadcast up to so many (under 50 MB); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: A plan of so many sources or fewer is broadcast (under 20 MB); a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size) to these and ``target``: shares of all sizes by weight, at most cap times a source's size, the excess
    given to the others by weight until none is above. Sources take the weights in turn by code point, null last; their ranks are places in range partitions
    plus the rows of those before."""
    order = F.col("source").isNull(), F.col("source")
    sources = cut(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    sources = sources.withColumn("pid", F.shiftright("at", 33))
    before = partition_offsets(sources.groupBy("pid").agg(F.count("*").alias("n"))).select("pid", "before")
    sources = sources.join(before, "pid")
    rank = F.col("before") + F.col("at") - F.shiftleft("pid", 33)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int"))
    ranked = cut(sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(cap)).alias("most")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    scale = 0.0
    while True:  # the set of the capped only grows, so this ends
        full = F.col("weight") * F.lit(scale) >= F.col("most")
        held, free = ranked.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        now = max(scale, (total - (held or 0.0)) / free) if free else scale
        if now == scale:
            break
        scale = now
    return ranked.select("source", "source_size", F.least("most", F.col("weight") * F.lit(scale)).alias("target"))


def numbered(df: DataFrame, key: str, repeated: DataFrame | None) -> DataFrame:
    """df with ``_place``: null for ids that occur once, else the number of the row among rows equal in all columns. repeated(id): the ids that occur more often.

    Equal rows are counted, which meets before the shuffle, and unfolded in blocks that are dealt to all tasks, so no task holds a group of them.
    """
    none = F.lit(None).cast("long")
    if repeated is None:
        return df.withColumn("_place", none)
    same = df[key].eqNullSafe(repeated["_id"])
    equal = df.join(repeated, same, "left_semi").groupBy(*df.columns).agg(F.count("*").alias("_times"))
    blocks = equal.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1, F.lit(PLACES).cast("long"))))
    many = blocks.repartition(df.sparkSession.sparkContext.defaultParallelism).withColumn("_place", F.explode(F.sequence("_first", F.least(F.col("_first") + PLACES, F.col("_times")) - 1)))
    return df.join(repeated, same, "left_anti").withColumn("_place", none).unionByName(many.drop("_times", "_first"))


def repeats(keys: DataFrame, key: str) -> DataFrame | None:
    """_id: the ids that occur more than once; None if there are none."""
    found = cut(keys.groupBy(F.col(key).alias("_id")).agg(F.count("*").alias("n")).where("n > 1").select("_id"))
    n = found.count()
    return None if not n else F.broadcast(found) if n <= BROADCAST_IDS else found


def order_code(key: Column, chance: Column, seed: int, row: Column | None = None, place: Column | None = None) -> Column:
    """Pareto order sampling's ranking value q, as the integer part of ``q / (1 + q) * 2**(BITS * STEPS)``, which keeps its order. A row with a place ranks by that, and the hash of
    the row, besides its key."""
    own = F.xxhash64(F.lit(seed), key)
    if place is not None:
        own = F.when(place.isNull(), own).otherwise(F.xxhash64(F.lit(seed), key, row, place))
    u = (F.pmod(own, F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    odds, least = u / (1 - u), F.lit(1e-12)
    q = odds / (F.greatest(chance, least) / (1 - chance))
    return F.least(F.floor(q / (1 + q) * F.lit(float(1 << BITS * STEPS))), F.lit((1 << BITS * STEPS) - 1)).cast("long")


def plan(sized: DataFrame, key: str, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 20) -> DataFrame:
    """sized: key, source, size, _row, _place. One row a source: source_size, target, whole (certain copies), chance, and the sample as ``runs``: documents with a code from
    ``low`` to below ``high`` and at most ``most`` words.

    The search for a run's end sums words by ranges of the order's value in each source, and again inside the range that does not fit; no task holds the rows of
    a source. Documents of equal code are taken together or not at all.
    """
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = cut(goals.select("source", "source_size", "target", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("chance")))
    rows = sized.alias("d").join(goals.alias("g"), F.expr("d.source <=> g.source")).select(
        F.col("d.source").alias("source"), "size", order_code(F.col(f"d.{key}"), F.col("chance"), seed, F.col("_row"), F.col("_place")).alias("code"))
    rows, end = cut(rows.where("size > 0")), 1 << BITS * STEPS
    state = goals.select("source", (F.col("target") * F.lit(NEAR)).alias("near"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"),
        F.lit(0).cast("long").alias("low"), F.array().cast("array<struct<low:bigint,high:bigint,most:double>>").alias("runs"))
    state = cut(state)
    while True:
        open_ = state.where(f"left > near AND left >= 1 AND low < {end}")
        if open_.isEmpty():
            break
        # first: what the run takes up to the range looked into, and that range (null: the run goes to the end)
        found = open_.select("source", F.col("left").cast("double").alias("most"), "low", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("prefix"))
        for step in range(1, STEPS + 1):
            shift = BITS * (STEPS - step)
            inside = rows.alias("r").join(found.alias("s"), F.expr(f"r.source <=> s.source AND shiftright(r.code, {shift + BITS}) = s.prefix AND r.code >= s.low AND r.size <= s.most"))
            sums = inside.groupBy(F.col("r.source").alias("source"), F.shiftright("r.code", shift).alias("bin")).agg(F.sum("size").alias("words"), F.first("taken").alias("taken"), F.first("most").alias("most"))
            sums = sums.withColumn("run", F.col("taken") + F.sum("words").over(W.partitionBy("source").orderBy("bin")))
            fits = F.col("run") <= F.col("most")
            ends = sums.groupBy("source").agg(F.max(F.when(fits, F.col("run"))).alias("run"), F.min(F.when(~fits, F.col("bin"))).alias("bin"))
            found = cut(found.alias("s").join(ends.alias("e"), F.expr("s.source <=> e.source"), "left").select("s.source", "most", "low", F.coalesce("run", "taken").alias("taken"), F.when(F.col("prefix").isNotNull(), F.col("bin")).alias("prefix")))
        high = F.coalesce("prefix", F.lit(end))
        run = F.struct("low", high.alias("high"), "most")
        was = found.select(F.col("source").alias("of"), "taken", run.alias("run"), (high + 1).alias("next"))
        state = state.join(was, F.expr("source <=> of"), "left").select("source", "near", (F.col("left") - F.coalesce("taken", F.lit(0))).alias("left"), F.coalesce("next", "low").alias("low"),
            F.when(F.col("taken") > 0, F.array_append("runs", F.col("run"))).otherwise(F.col("runs")).alias("runs"))
        state = cut(state)
    out = goals.alias("g").join(state.alias("s"), F.expr("g.source <=> s.source"))
    return cut(out.select("g.source", "source_size", "target", "whole", "chance", "runs"))


def _copies(df: DataFrame, key: str, source: str, size: Column, made: DataFrame, seed: int) -> DataFrame:
    """df with the plan's columns and ``_copies``."""
    made = made.select(*(F.col(c).alias(f"_mix_{c}") for c in made.columns))
    made = F.broadcast(made) if made.count() <= BROADCAST_SOURCES else made
    out = df.join(made, df[source].eqNullSafe(made["_mix_source"]))
    code = order_code(F.col(key), F.col("_mix_chance"), seed, F.col("_row"), F.col("_place"))
    out = out.withColumn("_code", code)
    chosen = F.exists("_mix_runs", lambda r: (F.col("_code") >= r["low"]) & (F.col("_code") < r["high"]) & (size <= r["most"]))
    return out.withColumn("_copies", F.col("_mix_whole") + F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0))


def _sized(docs: DataFrame, key: str, text: str, source: str) -> tuple[DataFrame, DataFrame | None]:
    """key, source, size, _row and _place of all documents, cut; and the ids that repeat. The hash of a whole row is taken only where ids repeat."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = {role: F.col(f"c{names.index(name)}") for role, name in (("key", key), ("source", source), ("text", text))}
    again = repeats(plain.select(at["key"].alias("key")), "key")
    row = F.lit(0).cast("long") if again is None else F.xxhash64(*plain.columns)
    sized = plain.select(at["key"].alias("key"), at["source"].alias("source"), word_count(at["text"]).alias("size"), row.alias("_row"))
    return cut(numbered(sized, "key", again)), again


def decided(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 20) -> DataFrame:
    """One row a document: key, size, source_size, target, copies, taken (words, repeats counted)."""
    prepared(docs.sparkSession)
    sized, _ = _sized(docs, key, text, source)
    out = _copies(sized, "key", "source", F.col("size"), plan(sized, "key", weights, cap, seed), seed)
    return out.select(F.col("key").alias(key), "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_copies").alias("copies"), (F.col("size") * F.col("_copies")).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 20) -> DataFrame:
    """The mix itself: docs' rows and columns, each row as often as the mix takes it."""
    prepared(docs.sparkSession)
    sized, again = _sized(docs, key, text, source)
    made = plan(sized, "key", weights, cap, seed)
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    rows = numbered(docs.toDF(*plain), plain[names.index(key)], again)
    rows = rows.withColumn("_row", F.lit(0).cast("long") if again is None else F.xxhash64(*plain))
    out = _copies(rows, plain[names.index(key)], plain[names.index(source)], word_count(F.col(plain[names.index(text)])), made, seed)
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select(*plain).toDF(*names)
