"""Which texts contain which others, by an index of their short substrings instead of a comparison of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram.
GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """Distinct substrings of so many characters; of size 0, the empty one."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.when(size == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size))))


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needles(needle), texts(text) to the distinct pairs needle, text where the text contains the needle; the empty needle is in every text.

    A text is posted under its grams, of those that any needle has; a needle is looked up under the gram of its own that the fewest texts have, and the texts posted there
    are verified. A needle shorter than a gram is one, so texts are also posted under shorter ones.
    """
    needles = needles.select("needle").where("needle IS NOT NULL").distinct()
    texts = texts.select("text").where("text IS NOT NULL").distinct()
    own = needles.select("needle", F.explode(_grams(F.col("needle"), F.least(F.length("needle"), F.lit(GRAM)))).alias("gram"))
    all_sizes = F.flatten(F.array(*(F.when(F.length("text") >= n, _grams(F.col("text"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(GRAM + 1))))
    posted = texts.select("text", F.explode(all_sizes).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi")
    counts = posted.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("first"))
    rarest = rarest.where("first.n > 0").select("needle", "first.gram")
    return rarest.join(posted, "gram").where(F.contains("text", F.col("needle"))).select("needle", "text")


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frames of one text column each, to the distinct pairs a, b where either contains the other."""
    a, b = a.toDF("a"), b.toDF("b")
    ahead = contained(b.select(F.col("b").alias("needle")), a.select(F.col("a").alias("text"))).select(F.col("text").alias("a"), F.col("needle").alias("b"))
    back = contained(a.select(F.col("a").alias("needle")), b.select(F.col("b").alias("text"))).select(F.col("needle").alias("a"), F.col("text").alias("b"))
    return ahead.union(back).distinct()
