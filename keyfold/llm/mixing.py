"""Mixing sources to target weights by hash-threshold histograms.  Native: DataFrame operations only.

A document's place is a hash of its doc_id (of its text, without one), so a mix is the same in each run and
a smaller budget takes a subset of what a larger one takes.  Sizes (words) are
summed by source and the hash's first digits; running sums find the bucket in
which a source's budget ends; only that bucket is summed again by the next
digits.  After three levels of 4096 buckets the threshold is known to 36 bits,
and documents are taken by comparing their hash with it.  Nothing is sorted but
the at most 4096 sums of a source and level.

Targets: ``share`` of all sizes, dealt by weight; a source's target stops at
``most`` times its size and the excess goes to the others by weight until none
is above.  With the sources in order of size over weight this is one running
sum.  A source takes its documents ``floor(target / size)`` times and the
remainder by threshold; the last bucket goes in if that is nearer to the target.

A source of null is a source of its own, last in order.  Null texts have size 0,
as have texts of white space.  Rows with the same doc_id share a place, as do rows without one with the same text.
All sums combine map-side, so a source with most of the rows is a few rows in
the shuffle.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_sums, ship, written

WORD = r"[^\x20\x09-\x0D]+"
DIGITS, LEVELS = 3, 3
#: Above every hash.
END = "g"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def place(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit("")).cast("binary")), 1, DIGITS * LEVELS)


def source_key(source: str = "source") -> Column:
    """Equal for equal sources, also for null, and ordered like them with null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("~"))


def targets(sizes: DataFrame, weights: tuple = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2) -> DataFrame:
    """key, source_size, target, copies, budget of each source; sizes: key and size of each document.

    Sources are numbered and summed along their order by ranges, so there may be as many as there are domains.
    """
    s = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    s = running_sums(s, ["key"], {"number": F.lit(1).cast("bigint")})
    s = s.select("key", "source_size", F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") - 1) % len(weights) + 1).cast("int")).alias("weight"))
    s = s.withColumn("ratio", F.col("source_size") / F.col("weight"))
    s = running_sums(s, ["ratio", "key"], {"capped": most * F.col("source_size"), "passed": F.col("weight")})
    total = s.agg(F.sum("source_size"), F.sum("weight")).first()
    cap = (most * F.col("source_size")).cast("double")
    # The level if the sources before this one are at their caps; it holds from the first that stays below its cap.
    room = F.lit(share * float(total[0] or 0)) - (F.col("capped").cast("double") - most * F.col("source_size"))
    s = s.withColumn("level", room / (F.lit(total[1] or 0.0) - F.col("passed") + F.col("weight")))
    first_level = s.where(F.col("level") * F.col("weight") <= cap).agg(F.max("level")).first()[0]
    s = s.withColumn("target", F.when(cap == 0, F.lit(0.0)).otherwise(F.least(cap, F.lit(first_level).cast("double") * F.col("weight"))))
    s = s.withColumn("copies", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("bigint"))
    return s.select("key", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"))


def thresholds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with ``last``: the hashes up to it are taken once more.

    sizes: key, h, size of each document.
    """
    inside, open_ = sizes, plan.select("key", "budget", F.lit("").alias("prefix"), F.lit(0).cast("bigint").alias("below"))
    for level in range(1, LEVELS + 1):
        digits = F.substring("h", 1, DIGITS * level)
        sums = inside.groupBy("key", digits.alias("bucket")).agg(F.sum("size").alias("n")).join(open_, "key")
        running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.col("below") + F.sum("n").over(running))
        if level < LEVELS:
            # The budget ends in the first bucket that oversteps it: all before it goes in, nothing after.
            edge = sums.where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("n") <= F.col("budget")))
            open_ = edge.select("key", "budget", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("n")).alias("below"))
            inside = inside.join(open_.select("key", F.col("prefix").alias("edge")), "key").where(F.col("edge") == digits).drop("edge")
        else:
            nearest = F.col("upto") - F.col("n") + F.col("n") / F.lit(2.0) <= F.col("budget")
            last = sums.groupBy("key").agg(F.max(F.when(nearest, F.col("bucket"))).alias("inner_last"), F.min("prefix").alias("prefix"))
            # Without such a bucket, all that is below the edge's prefix: its hashes are longer, so they sort after it.
            found = last.select("key", F.coalesce("inner_last", "prefix").alias("last"))
    # A source that no bucket oversteps has no edge: all of it goes in.
    return plan.join(found, "key", "left").withColumn("last", F.coalesce("last", F.lit(END)))


def plan_mix(docs: DataFrame, weights: tuple = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and places (doc_id, key, h, size), and the sources' plan (key, source_size, target, copies, budget, last)."""
    sizes, _ = written(docs.select("doc_id", source_key().alias("key"), place().alias("h"), words().alias("size")), "mix-sizes")
    plan, _ = written(thresholds(sizes, targets(sizes, weights, share, most)), "mix-plan")
    return sizes, plan


def mix(docs: DataFrame, weights: tuple = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, copies (of the whole document) of each row."""
    sizes, plan = plan_mix(docs, weights, share, most)
    out = sizes.join(plan, "key")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") + (F.col("h") <= F.col("last")).cast("bigint")).alias("copies"))


def take(docs: DataFrame, weights: tuple = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of docs that the mix takes, with ``copies``, how often (in place of a column of that name)."""
    _, plan = plan_mix(docs, weights, share, most)
    columns = [F.col(f"d.`{c}`").alias(c) for c in docs.columns if c.lower() != "copies"]
    out = docs.alias("d").join(plan.alias("p"), source_key("d.source") == F.col("p.key"))
    copies = F.col("p.copies") + (place("d.doc_id", "d.text") <= F.col("p.last")).cast("bigint")
    return out.where(copies > 0).select(*columns, copies.alias("copies"))


def digest(mixed: DataFrame) -> DataFrame:
    """The columns of the standard query."""
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ship(__name__)
