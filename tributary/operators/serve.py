"""Serving: from buckets and cursors to the lines of a response, many buckets in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.render import put_checksum, quoted
from .cdc import entry_checksum

SNAPSHOT_PAGE, DELTA_PAGE = 256, 256


def decide(cursors: DataFrame, last_op_id: int, snapshot_floor: int, retained_floor: int) -> DataFrame:
    """Adds mode to cursors (bucket, after): snapshot without a cursor (null or 0), reset if it is beyond the end or
    below a floor, else delta."""
    after = F.col("after")
    reset = (after > last_op_id) | (after < max(snapshot_floor, retained_floor))
    return cursors.withColumn("mode", F.when(F.coalesce(after, F.lit(0)) == 0, "snapshot").when(reset, "reset").otherwise("delta"))


def snapshot_entries(rows: DataFrame, cursors: DataFrame, last_op_id: int, superseded: DataFrame | None = None) -> DataFrame:
    """Entries of whole buckets: documents by type and id with synthetic operation ids that end at last_op_id. rows:
    (bucket, object_type, object_id, data). A reset begins with CLEAR, which takes the first; so does a bucket of which
    something is superseded (bucket, checksum), for CLEAR then carries that checksum and the sums agree."""
    wanted = cursors.filter("mode != 'delta'").select("bucket", (F.col("mode") == "reset").alias("reset"))
    if superseded is None:
        wanted = wanted.withColumn("old", F.lit(0).cast("long"))
    else:
        sums = superseded.select("bucket", F.col("checksum").cast("long").alias("old"))
        wanted = wanted.join(sums, "bucket", "left").select("bucket", (F.col("reset") | (F.coalesce("old", F.lit(0)) != 0)).alias("reset"), F.coalesce("old", F.lit(0)).alias("old"))
    docs = rows.join(F.broadcast(wanted.select("bucket")), "bucket").select("bucket", F.lit(1).alias("kind"), F.lit("PUT").alias("op"), "object_type", "object_id", "data", put_checksum(F.col("object_type"), F.col("object_id"), F.col("data")).alias("checksum"))
    none = F.lit(None).cast("string")
    clears = wanted.filter("reset").select("bucket", F.lit(0).alias("kind"), F.lit("CLEAR").alias("op"), none.alias("object_type"), none.alias("object_id"), none.alias("data"), F.col("old").alias("checksum"))
    own = Window.partitionBy("bucket")
    nth = F.row_number().over(own.orderBy("kind", "object_type", "object_id"))
    size = F.count(F.lit(1)).over(own)
    return docs.unionByName(clears).withColumn("op_id", F.lit(last_op_id) - size + nth).drop("kind")


def delta_entries(found: DataFrame, cursors: DataFrame) -> DataFrame:
    """Entries of buckets since their cursors, from per-bucket effects of the log."""
    wanted = cursors.filter("mode = 'delta'").select("bucket", "after")
    since = found.join(F.broadcast(wanted), "bucket").filter(F.col("op_id") > F.col("after"))
    return since.select("bucket", F.col("effect").alias("op"), "object_type", "object_id", "data", entry_checksum().alias("checksum"), "op_id").distinct()


def pages(entries: DataFrame, cursors: DataFrame, size: int = SNAPSHOT_PAGE) -> DataFrame:
    """Adds nth (from 1), page (from 0), and to each page the chain after, next_after and has_more, in rows
    (bucket, page, first, last, n, after, next_after, has_more)."""
    order = Window.partitionBy("bucket").orderBy("op_id")
    numbered = entries.withColumn("page", F.floor((F.row_number().over(order) - 1) / size).cast("long"))
    per = numbered.groupBy("bucket", "page").agg(F.min("op_id").alias("first"), F.max("op_id").alias("last"), F.count(F.lit(1)).alias("n"))
    chain = Window.partitionBy("bucket").orderBy("page")
    joined = per.join(F.broadcast(cursors.select("bucket", F.when(F.col("mode") == "delta", F.col("after")).otherwise(F.lit(0)).cast("long").alias("start"))), "bucket")
    return joined.select("bucket", "page", "first", "last", "n", F.coalesce(F.lag("last").over(chain), "start").alias("after"), F.col("last").alias("next_after"), F.lead("page").over(chain).isNotNull().alias("has_more"))


def number(c: Column) -> Column:
    return c.cast("string")


def entry_json() -> Column:
    parts = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    text = parts(
        '{"op_id":"',
        number(F.col("op_id")),
        '","op":',
        quoted(F.col("op")),
        F.when(F.col("object_type").isNotNull(), parts(',"object_type":', quoted(F.col("object_type")), ',"object_id":', quoted(F.col("object_id")))).otherwise(""),
        F.when(F.col("data").isNotNull(), parts(',"data":', quoted(F.col("data")))).otherwise(""),
        ',"checksum":',
        number(F.col("checksum")),
        F.when(F.col("object_type").isNotNull(), parts(',"subkey":', quoted(F.concat("object_type", F.lit("/"), "object_id")))).otherwise(""),
        "}",
    )
    return text


def lines(checkpoints: DataFrame, entries: DataFrame, cursors: DataFrame, last_op_id: int, page: int = SNAPSHOT_PAGE) -> DataFrame:
    """The response as (line_no, kind, bucket, page, json): a checkpoint, data pages by bucket, checkpoint_complete.

    Each page is one line, so a row holds `page` entries at most; only the checkpoint line has all buckets of a
    request, whose number is bounded. Lines are numbered from the buckets' page counts, not by sorting them all."""
    asked = F.broadcast(cursors.select("bucket"))
    sums = asked.join(checkpoints, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("checksum", F.lit(0)).alias("checksum"))
    one = F.concat(F.lit('{"bucket":'), quoted(F.col("bucket")), F.lit(',"checksum":'), number(F.col("checksum")), F.lit(',"count":'), number(F.col("count")), F.lit(',"priority":3,"subscriptions":[{"default":0}]}'))
    stream = F.regexp_extract("bucket", r"^1#(.*?)\|", 1)
    head = sums.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", one.alias("j")))), lambda x: x["j"]), ",").alias("buckets"), F.array_join(F.transform(F.sort_array(F.collect_set(stream)), lambda s: F.concat(F.lit('{"name":'), quoted(s), F.lit(',"is_default":true,"errors":[]}'))), ",").alias("streams"))
    none = F.lit(None).cast("string")
    outer = lambda line, kind, text: head.select(line.cast("long").alias("line_no"), F.lit(kind).alias("kind"), none.alias("bucket"), F.lit(0).cast("long").alias("page"), text.alias("json"))
    first = outer(F.lit(0), "checkpoint", F.concat(F.lit(f'{{"checkpoint":{{"last_op_id":"{last_op_id}","write_checkpoint":null,"buckets":['), "buckets", F.lit('],"streams":['), "streams", F.lit("]}}")))
    order = Window.partitionBy("bucket").orderBy("op_id")
    numbered = entries.withColumn("page", F.floor((F.row_number().over(order) - 1) / page).cast("long"))
    bodies = numbered.groupBy("bucket", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("op_id", entry_json().alias("j")))), lambda x: x["j"]), ",").alias("body"))
    chain = pages(entries, cursors, page)
    counts = chain.groupBy("bucket").agg(F.count(F.lit(1)).alias("lines"))  # a row a bucket of the request
    before = counts.select("bucket", (F.sum("lines").over(Window.orderBy("bucket")) - F.col("lines")).alias("before"))
    data = bodies.join(chain, ["bucket", "page"]).join(F.broadcast(before), "bucket").select(
        (1 + F.col("before") + F.col("page")).cast("long").alias("line_no"),
        F.lit("data").alias("kind"),
        "bucket",
        "page",
        F.concat(F.lit('{"data":{"bucket":'), quoted(F.col("bucket")), F.lit(',"data":['), "body", F.lit('],"has_more":'), F.col("has_more").cast("string"), F.lit(',"after":"'), number(F.col("after")), F.lit('","next_after":"'), number(F.col("next_after")), F.lit('"}}')).alias("json"),
    )
    total = counts.agg((1 + F.coalesce(F.sum("lines"), F.lit(0))).cast("long").alias("line_no"))
    done = F.lit(f'{{"checkpoint_complete":{{"last_op_id":"{last_op_id}"}}}}')
    last = total.select("line_no", F.lit("checkpoint_complete").alias("kind"), none.alias("bucket"), F.lit(0).cast("long").alias("page"), done.alias("json"))
    return first.unionByName(data).unionByName(last)


def advance(cursors: DataFrame, last_op_id: int) -> DataFrame:
    """Cursors after a response: every bucket asked for stands at the checkpoint."""
    return cursors.select("bucket", F.lit(last_op_id).cast("long").alias("after"))

