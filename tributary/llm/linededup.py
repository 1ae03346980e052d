"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines of a document is hashed (128 bits). All
windows are counted by hash; the first occurrence, by document and position,
stays, and each later one marks its three lines. Marked positions of a document
are merged, so that overlapping windows remove a passage as a whole, and the
lines left are joined again. Only hashes and positions are shuffled, and hot
windows are pre-aggregated; texts are read again at the end.

Defined cases: null text stays null and a text of fewer than three lines stays
as it is; windows without any non-blank line are not compared; a document whose
lines all go becomes an empty text and stays as a row; rows equal in doc_id and
text are one occurrence and treated alike, while rows with the same doc_id and
other text are told apart by the text's hash; null ids sort last; within one
document, later copies of a passage go too; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize, small

SPAN = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, sign, pos, h1, h2) of every window of `span` consecutive lines that is not all blank."""
    base = docs.select("doc_id", F.xxhash64("text").alias("sign"), lines_of(F.col("text")).alias("lines")).filter(F.size("lines") >= span)

    def window(i: Column) -> Column:
        parts = [F.element_at(F.col("lines"), (i + k + 1).cast("int")) for k in range(span)]
        some = F.btrim(F.concat(*parts), F.lit(" \t\r\x0b\x0c")) != ""
        return F.struct(i.cast("int").alias("pos"), F.when(some, F.xxhash64(*parts)).alias("h1"), F.xxhash64(F.lit(7), *parts).alias("h2"))

    each = F.transform(F.sequence(F.lit(0), F.size("lines") - span), window)
    return base.select("doc_id", "sign", F.explode(each).alias("w")).select("doc_id", "sign", "w.pos", "w.h1", "w.h2").filter("h1 is not null")


def order_key() -> Column:
    """Of an occurrence, ordered by document and position, null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sign", "pos")


def removals(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, sign, gone): the merged line positions that later occurrences cover, one row a document that loses any."""
    found = windows(docs, span)
    first = found.groupBy("h1", "h2").agg(F.min(order_key()).alias("at"), F.max(order_key()).alias("last")).filter("at != last").select("h1", "h2", "at")
    first = materialize(first, "lines-first")
    later = attach(found.withColumn("key", order_key()), first, ["h1", "h2"], "inner").filter("key != at")
    covered = F.explode(F.sequence(F.col("pos"), F.col("pos") + span - 1))
    # a document's positions are bounded by its own lines; the set is built map-side first
    return later.select("doc_id", "sign", covered.alias("pos")).groupBy("doc_id", "sign").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs with later occurrences of repeated passages removed from text, and lines_removed (long) added last."""
    gone = materialize(removals(docs, span), "lines-gone").select(F.col("doc_id").alias("__ld_id"), F.col("sign").alias("__ld_sign"), F.col("gone").alias("__ld_gone"))
    same = docs["doc_id"].eqNullSafe(gone["__ld_id"]) & (F.xxhash64(docs["text"]) == gone["__ld_sign"])
    joined = docs.join(F.broadcast(gone) if small(gone) else gone, same, "left")
    lines = lines_of(docs["text"])
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__ld_gone"))
    cleaned = F.when(F.col("__ld_gone").isNull(), docs["text"]).otherwise(F.concat_ws("\n", F.transform(kept, lambda p: F.element_at(lines, p + 1))))
    columns = [cleaned.alias(c) if c == "text" else docs[c] for c in docs.columns if c != "lines_removed"]
    return joined.select(*columns, F.when(F.col("__ld_gone").isNull(), 0).otherwise(F.size("__ld_gone")).cast("long").alias("lines_removed"))
