"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a budget of words. Documents are ordered by a hash of id and
text; a source takes the hash prefix that fills its budget, the boundary
position only as far as there is room. The threshold is found level by level: a
histogram of words by (source, hash bucket) shows the boundary bucket, and only
that bucket is counted again with finer buckets. Nothing is sorted; documents
are then filtered by comparing their hash with the threshold of their source.
Because a threshold only grows with its budget, mixes of growing budgets are
nested: no document gives fewer words to the larger one.

The document at the boundary gives its first `taken` words, so that a source of
few long documents meets its target too; all others are taken whole, once or
`most` times.

Defined cases: null or empty text has size 0 and is never taken; a null source
is a source of its own, ranked last; rows that repeat an id and a text share a
position, and if that is the boundary each gives the same part of its words;
rows with equal or null ids and other texts are told apart by the text; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, materialize, word_count

#: Cycle of source weights, by rank of the source name.
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words, and at most so many times a source's own.
SHARE, MOST = 1.5, 2
#: Hash digits (hexadecimal) refined at each level, and levels.
DIGITS, LEVELS = 3, 4


def position(doc_id: Column, text: Column) -> Column:
    """The place of a document in its source's order: the first 48 bits of an MD5 of its id and its text's MD5."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(" "), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, DIGITS * LEVELS), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Never null, ordered by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From (skey, source_size), one row a source, add target: words shared by weight, capped at `most` times the
    source's size, the excess reshared by weight among the others until no target is above its cap.

    The fixed point of that resharing is target = min(cap, level * weight), where level follows from the sources in
    the order of cap / weight. This works on one row a source."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(everything.orderBy("skey")) - 1)
    weight = F.lit(weights[-1])
    for i, w in list(enumerate(weights))[:-1]:
        weight = F.when(F.col("rank") % len(weights) == i, w).otherwise(weight)
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = everything.orderBy(F.col("cap") / F.col("weight"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", (F.col("all_words") * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    )
    # the first source, in this order, that its level does not fill up to its cap sets the level of all after it
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("cap_rank", "level"))).over(everything)
    return (
        filled.withColumn("cap_rank", F.row_number().over(order))
        .withColumn("at", level)
        .select("skey", "source_size", F.when(F.col("at").isNull() | (F.col("cap_rank") < F.col("at.cap_rank")), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("at.level") * F.col("weight"))).alias("target"))
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(skey, end, room, unit) for each (skey, budget): positions below `end` are taken, and of the words at it (unit)
    as many as there is room for.

    rows has (skey, h, size). Level after level a histogram of the boundary bucket alone is made, straight from the
    rows; at the last level a bucket is a single position."""
    found = budgets.select("skey", "budget", F.lit(0).cast("long").alias("base"))
    whole = 16**DIGITS
    by = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # of 16 ** DIGITS rows
    boundary = done = None
    for level in range(1, LEVELS + 1):
        part = rows.withColumn("bucket", F.floor(F.col("h") / F.lit(whole ** (LEVELS - level))))
        if boundary is not None:
            part = attach(part.withColumn("prefix", F.floor(F.col("bucket") / F.lit(whole))), boundary, ["skey", "prefix"], "left_semi")
        histogram = part.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
        walked = attach(histogram, found, ["skey"], "inner").withColumn("upto", F.col("base") + F.sum("words").over(by))
        over = F.col("upto") > F.col("budget")
        found = materialize(
            walked.groupBy("skey").agg(
                F.first("budget").alias("budget"),
                F.min(F.when(over, F.col("bucket"))).alias("prefix"),
                F.coalesce(F.max(F.when(~over, F.col("upto"))), F.first("base")).alias("base"),
                F.min(F.when(over, F.struct("bucket", "words")))["words"].alias("unit"),
            ),
            f"mix-level{level}",
        )
        if level < LEVELS:
            closed = found.filter("prefix is null")
            done = closed if done is None else done.unionByName(closed)
            boundary = materialize(found.filter("prefix is not null").select("skey", "prefix"), "mix-boundary")
            found = materialize(found.filter("prefix is not null").select("skey", "budget", "base"), "mix-open")
    found = found.unionByName(done)
    return found.select("skey", F.coalesce("prefix", F.lit(whole**LEVELS)).cast("long").alias("end"), F.floor(F.col("budget") - F.col("base")).cast("long").alias("room"), F.coalesce("unit", F.lit(1)).cast("long").alias("unit"))


def measured(docs: DataFrame, *columns: str) -> DataFrame:
    """Some columns of docs, with what decides about a document: __size, __skey and __h."""
    return docs.select(*[docs[c] for c in columns], word_count(docs["text"]).alias("__size"), source_key(docs["source"]).alias("__skey"), position(docs["doc_id"], docs["text"]).alias("__h"))


def plan_of(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: __skey, __source_size, __target, __whole (copies of every document), __end, __room, __unit."""
    rows = rows.select(F.col("__skey").alias("skey"), F.col("__size").alias("size"), F.col("__h").alias("h"))
    sizes = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    # whole copies come first; the threshold decides on the rest of the budget
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most - 1), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    targets = materialize(source_targets(sizes, weights, share, most).withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    plan = targets.drop("budget").join(thresholds(rows, targets), "skey")
    return materialize(plan.select(*[F.col(c).alias(f"__{c}") for c in ("skey", "source_size", "target", "whole", "end", "room", "unit")]), "mix-plan")


def taken_words() -> Column:
    part = F.when(F.col("__h") < F.col("__end"), F.col("__size")).when(F.col("__h") == F.col("__end"), F.floor(F.col("__size") * F.col("__room") / F.col("__unit"))).otherwise(F.lit(0))
    return (F.col("__size") * F.col("__whole") + part).cast("long")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target (of its source), taken (words, repeats counted)
    and copies (0 to `most`, the last of them cut if taken is not a multiple of size); reruns agree, since positions
    depend on ids and texts alone."""
    rows = materialize(measured(docs, "doc_id", "source"), "mix-sizes")
    joined = attach(rows, plan_of(rows, weights, share, most), ["__skey"], "inner").withColumn("taken", taken_words())
    copies = F.when(F.col("__size") > 0, F.ceil(F.col("taken") / F.col("__size"))).otherwise(F.lit(0)).cast("long")
    return joined.select("doc_id", "source", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), "taken", copies.alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, each once, with size, source_size, target, taken and copies. What is taken of
    a row follows from its id, text and source and the plan of its source, so that no row is matched with another."""
    rows = materialize(measured(docs), "mix-sizes")
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "copies")]
    joined = attach(measured(docs, *names), plan_of(rows), ["__skey"], "inner").withColumn("__taken", taken_words()).filter("__taken > 0")
    return joined.select(*[joined[f"`{c}`"] for c in names], F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"), F.ceil(F.col("__taken") / F.col("__size")).cast("long").alias("copies"))
