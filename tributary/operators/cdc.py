"""Change data capture: from ordered changes to operations, current state, per-bucket effects and checkpoints.

Changes are rows (lsn, seq, kind, object_type, id, old_id, data, old_present,
routes): the documents of old and new tuples, rendered. What the sequential
definition says of one operation after another is said here by windows over the
operations of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.render import checksum_sum, put_checksum, remove_checksum, signed, wrapped
from ..sources.tables import settled


def derive(changes: DataFrame) -> DataFrame:
    """Operations (lsn, seq, sub, op, object_type, object_id, data, route): insert gives PUT; update gives REMOVE of the
    old tuple if the change has it, and PUT; delete gives REMOVE; truncate fails.

    changes: (lsn, seq, kind, object_type, object_id, data, route, old_id, old_route); old_id is null if the change
    carries no old tuple."""
    put = F.struct(F.lit(1).alias("sub"), F.lit("PUT").alias("op"), F.col("object_id"), F.col("data"), F.col("route"))
    gone = lambda ident, route: F.struct(F.lit(0).alias("sub"), F.lit("REMOVE").alias("op"), ident.alias("object_id"), F.lit(None).cast("string").alias("data"), route.alias("route"))
    old = gone(F.col("old_id"), F.col("old_route"))
    ops = (
        F.when(F.col("kind") == "insert", F.array(put))
        .when(F.col("kind") == "update", F.when(F.col("old_id").isNotNull(), F.array(old, put)).otherwise(F.array(put)))
        .when(F.col("kind") == "delete", F.array(gone(F.coalesce("old_id", "object_id"), F.coalesce("old_route", "route"))))
        .otherwise(F.raise_error(F.concat(F.lit("not supported: "), F.col("kind"))).cast("array<struct<sub:int,op:string,object_id:string,data:string,route:string>>"))
    )
    return changes.select("lsn", "seq", "object_type", F.explode(ops).alias("o")).select("lsn", "seq", "object_type", "o.*")


ORDER = ("lsn", "seq", "sub")


#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33


def in_order(df: DataFrame, *order: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """df by one range exchange, with part (ranges in order) and row (from 0, sorted in each), settled; and the number
    of rows of each part that has any, one small row a partition."""
    at = F.monotonically_increasing_id()
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at)
    kept = settled(spread).withColumns({"part": F.shiftright("at", ROW_BITS).cast("int"), "row": F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))}).drop("at")
    sizes = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()
    return kept, sorted((r["part"], r["n"]) for r in sizes)


def with_op_ids(ops: DataFrame, last_op_id: int = 0) -> DataFrame:
    """Dense operation ids in commit order, after last_op_id. Operations are shuffled once, by range; a row's number in
    its range and the rows of the ranges before it make its id."""
    kept, sizes = in_order(ops, *ORDER)
    before, total = {}, last_op_id
    for part, n in sizes:
        before[part] = total
        total += n
    if not before:
        return kept.drop("part", "row").withColumn("op_id", F.lit(0).cast("long"))
    starts = F.element_at(F.create_map(*[F.lit(x) for part, b in before.items() for x in (part, b)]), F.col("part"))
    return kept.withColumn("op_id", (starts + F.col("row") + 1).cast("long")).drop("part", "row")


def keyed() -> Window:
    return Window.partitionBy("object_type", "object_id").orderBy("op_id")


def enrich(ops: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Adds the image before each operation (previous_data, previous_route): that of the operation before it on the
    same key, else that in current; null after a REMOVE."""
    image = F.struct("data", "route")
    before = ops.withColumn("prev", F.lag(F.when(F.col("op") == "PUT", image)).over(keyed())).withColumn("later", F.lag(F.lit(True)).over(keyed()))
    if current is not None:
        state = current.select("object_type", "object_id", F.struct(F.col("data"), F.col("route")).alias("stored"))
        before = before.join(state, ["object_type", "object_id"], "left").withColumn("prev", F.when(F.col("later"), F.col("prev")).otherwise(F.col("stored"))).drop("stored")
    return before.withColumns({"previous_data": F.col("prev.data"), "previous_route": F.col("prev.route")}).drop("prev", "later")


def latest(ops: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Current documents (object_type, object_id, data, route, op_id): the last operation of each key wins, and a
    REMOVE takes the document away."""
    rows = ops.select("object_type", "object_id", "op", "data", "route", "op_id")
    if current is not None:
        rows = rows.unionByName(current.select("object_type", "object_id", F.lit("PUT").alias("op"), "data", "route", F.col("op_id")))
    last = rows.groupBy("object_type", "object_id").agg(F.max_by(F.struct("op", "data", "route"), "op_id").alias("s"), F.max("op_id").alias("op_id"))
    return last.filter("s.op = 'PUT'").select("object_type", "object_id", "s.data", "s.route", "op_id")


def effects(tail: DataFrame, bucket) -> DataFrame:
    """What each operation does to each bucket it touches: (op_id, bucket, effect, object_type, object_id, data,
    previous_data). PUT where the document now is, REMOVE where it was and no longer is. bucket(route) names a
    bucket."""
    now = F.when(F.col("op") == "PUT", bucket(F.col("route")))
    was = F.when(F.col("previous_data").isNotNull(), bucket(F.col("previous_route")))
    both = tail.withColumns({"now": now, "was": was})
    touched = both.withColumn("bucket", F.explode(F.array_distinct(F.array_compact(F.array("now", "was")))))
    put = F.coalesce(F.col("now") == F.col("bucket"), F.lit(False))
    return touched.select(
        "op_id",
        "bucket",
        F.when(put, "PUT").otherwise("REMOVE").alias("effect"),
        "object_type",
        "object_id",
        F.when(put, F.col("data")).alias("data"),
        F.when(F.coalesce(F.col("was") == F.col("bucket"), F.lit(False)), F.col("previous_data")).alias("previous_data"),
    )


def entry_checksum() -> Column:
    subkey = F.concat("object_type", F.lit("/"), "object_id")
    return F.when(F.col("effect") == "PUT", put_checksum(F.col("object_type"), F.col("object_id"), F.col("data"))).otherwise(remove_checksum(subkey))


def current_checkpoint(rows: DataFrame) -> DataFrame:
    """(bucket, count, checksum) of current documents (bucket, object_type, object_id, data); checksum unsigned."""
    own = rows.select("bucket", put_checksum(F.col("object_type"), F.col("object_id"), F.col("data")).alias("checksum"))
    return own.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), checksum_sum().alias("checksum"))


def superseded_checkpoint(found: DataFrame) -> DataFrame:
    """(bucket, count, checksum) of what current documents no longer show: PUTs replaced or removed, and REMOVEs."""
    removed = F.col("effect") == "REMOVE"
    old = F.when(F.col("previous_data").isNotNull(), put_checksum(F.col("object_type"), F.col("object_id"), F.col("previous_data")))
    parts = F.array_compact(F.array(old, F.when(removed, entry_checksum())))
    return found.select("bucket", F.explode(parts).alias("checksum")).groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), checksum_sum().alias("checksum"))


def checkpoint(*parts: DataFrame) -> DataFrame:
    """Sums partial checkpoints: (bucket, count, checksum), the checksum signed as it is sent."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("bucket").agg(F.sum("count").alias("count"), signed(wrapped(F.sum("checksum"))).alias("checksum"))


def retained(tail: DataFrame, last_op_id: int, keep: int) -> DataFrame:
    """The last `keep` operations."""
    return tail.filter(F.col("op_id") > last_op_id - keep)


def not_yet_applied(changes: DataFrame, last_lsn: int) -> DataFrame:
    """Changes of transactions beyond the stored position; a redelivered transaction is skipped."""
    return changes.filter(F.col("lsn") > last_lsn)


def check_transactions(events: DataFrame) -> DataFrame:
    """Transactions (xid, n_changes) of raw events (lsn, xid, seq, kind): one begin, before all, and one commit, after
    all, or an error."""
    per = events.groupBy("xid").agg(
        F.count(F.when(F.col("kind") == "begin", 1)).alias("begins"),
        F.count(F.when(F.col("kind") == "commit", 1)).alias("commits"),
        F.min_by("kind", "seq").alias("first"),
        F.max_by("kind", "seq").alias("last"),
        F.count(F.when(~F.col("kind").isin("begin", "commit"), 1)).alias("n_changes"),
    )
    whole = (F.col("begins") == 1) & (F.col("commits") == 1) & (F.col("first") == "begin") & (F.col("last") == "commit")
    return per.select("xid", F.when(whole, F.col("n_changes")).otherwise(F.raise_error(F.concat(F.lit("transaction is not whole: "), F.col("xid").cast("string"))).cast("long")).alias("n_changes"))


def carry_forward(changes: DataFrame, columns: list[str], stored: DataFrame | None = None) -> DataFrame:
    """Lookup rows after changes (id, lsn, seq, present: array of column names, columns...): a column that a change
    does not carry keeps its last value; the last row of each id."""
    order = Window.partitionBy("id").orderBy("lsn", "seq").rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.last(F.when(F.array_contains("present", c), F.struct(F.col(c).alias("v"))), ignorenulls=True).over(order)["v"] for c in columns}
    rows = changes.withColumns({f"f_{c}": v for c, v in filled.items()})
    last = rows.groupBy("id").agg(F.max_by(F.struct(*[F.col(f"f_{c}").alias(c) for c in columns]), F.struct("lsn", "seq")).alias("s")).select("id", "s.*")
    if stored is None:
        return last
    seen = changes.select(F.explode("present").alias("c"), "id").groupBy("id").agg(F.collect_set("c").alias("given"))
    old = stored.select(F.col("id").alias("old"), *[F.col(c).alias(f"o_{c}") for c in columns])
    joined = last.join(seen, "id", "left").join(old, F.col("id") == F.col("old"), "full")
    return joined.select(F.coalesce("id", "old").alias("id"), *[F.when(F.col("id").isNotNull() & F.coalesce(F.array_contains("given", c), F.lit(False)), F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in columns])


def fold_lookup(changes: DataFrame, columns: list[str], stored: DataFrame) -> DataFrame:
    """Lookup rows (id, columns...) after changes (id, lsn, seq, kind, old_id, present, columns...): what carry_forward
    keeps, without rows that were deleted since or have another id now. A row that comes after its delete begins
    anew."""
    at = F.struct("lsn", "seq")
    gone = changes.filter("kind = 'delete'").select("id", at.alias("at"))
    gone = gone.unionByName(changes.filter("kind != 'delete' and old_id is not null and old_id != id").select(F.col("old_id").alias("id"), at.alias("at")))
    last = gone.groupBy("id").agg(F.max("at").alias("gone_at"))
    live = changes.filter("kind != 'delete'").join(last, "id", "left").filter(F.col("gone_at").isNull() | (at > F.col("gone_at")))
    left = stored.join(last, "id", "left_anti")
    return carry_forward(live.select("id", "lsn", "seq", "present", *columns), columns, left)
