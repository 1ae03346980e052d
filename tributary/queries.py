"""Queries over the test tables for the engine's operators, each with SQL that gives the same rows.

Roles: orders are the main documents, customer is the membership lookup, events
are the change log (one transaction an event; `error` deletes, all else puts;
documents are users and move between buckets by event type), conversations have
a computed id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import render
from .operators import buckets, cdc, predicates, serve
from .plans.compiler import compile_rules, compile_streams
from .sources import fixtures
from .sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


ORDER_DOC = "SELECT o_orderkey AS id, o_custkey, o_orderstatus FROM orders"
#: SQL of the same document, of its checksum (h: its SHA-256), and of a signed wrapped sum.
ORDER_JSON = """'{"id":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}'"""


def u32(text: str) -> str:
    h = f"sha256({text})"
    return "('0x' || " + " || ".join(f"substr({h}, {i}, 2)" for i in (7, 5, 3, 1)) + ")::BIGINT"


def signed_sum(x: str) -> str:
    wrapped = f"(sum({x})::HUGEINT % 4294967296)"
    return f"(CASE WHEN {wrapped} >= 2147483648 THEN {wrapped} - 4294967296 ELSE {wrapped} END)::BIGINT"


def put_sql(kind: str, ident: str, data: str) -> str:
    return u32(f"'put.' || {kind} || '.' || {ident} || '.' || {data}")


def remove_sql(kind: str, ident: str) -> str:
    return u32(f"'delete.' || {kind} || '/' || {ident}")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: read_table(spark, sf_dir, n) for n in names}


def stream_of(spark: SparkSession, sf_dir: str, name: str, *queries: str, with_: dict | None = None, extra: dict | None = None) -> DataFrame:
    plan = compile_streams([(name, queries, False)], with_)
    have = extra or {}
    return buckets.stream_rows(plan.streams[0], have | {t: read_table(spark, sf_dir, t) for t in plan.sources() if t not in have})


def matching(spark: SparkSession, sf_dir: str, where: str, table: str = "orders", key: str = "o_orderkey", extra: dict | None = None) -> DataFrame:
    rows = stream_of(spark, sf_dir, "m", f"SELECT {key} AS id FROM {table} WHERE {where}", extra=extra)
    return rows.select(F.col("object_id"))


# -- documents and buckets ---------------------------------------------------------------------------------------------


@query(f"SELECT '1#orders|0[\"' || o_custkey || '\"]' AS bucket, o_orderkey::VARCHAR AS object_id, {ORDER_JSON} AS data FROM orders")
def bucket_docs_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_of(spark, sf_dir, "orders", f"{ORDER_DOC} WHERE o_custkey = auth.parameter('custkey')")
    return rows.select("bucket", "object_id", "data")


@query(f"SELECT '1#orders|0[\"' || o_custkey || '\"]' AS bucket, count(*) AS count, {signed_sum(put_sql("'orders'", 'o_orderkey', ORDER_JSON))} AS checksum FROM orders GROUP BY o_custkey")
def bucket_checkpoint_all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.checkpoint(cdc.current_checkpoint(stream_of(spark, sf_dir, "orders", f"{ORDER_DOC} WHERE o_custkey = auth.parameter('custkey')")))


NATION_JSON = """'{"id":' || n_nationkey || ',"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}'"""


@query(f"SELECT '1#nations|0[]' AS bucket, count(*) AS count, {signed_sum(put_sql("'nation'", 'n_nationkey', NATION_JSON))} AS checksum FROM nation")
def default_bucket_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream subscribed by default, with * and the table's own id."""
    plan = compile_rules("streams:\n  nations:\n    auto_subscribe: true\n    query: SELECT * FROM public.nation\n")
    source = read_table(spark, sf_dir, "nation").withColumn("id", F.col("n_nationkey"))
    rows = buckets.plan_rows(plan, {"nation": source}).filter(F.col("bucket").isin(buckets.default_buckets(plan, {})))
    return cdc.checkpoint(cdc.current_checkpoint(rows))


@query("SELECT conv_id || '.' || turn AS object_id, '{\"id\":\"' || conv_id || '.' || turn || '\",\"label\":\"' || role || '/' || turn || '\"}' AS data FROM conversations")
def computed_id_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_of(spark, sf_dir, "c", "SELECT conv_id || '.' || turn AS id, role || '/' || turn AS label FROM conversations")
    return rows.select("object_id", "data")


@query(
    """SELECT '1#cust|' || g || '["' || k || '"]' AS bucket, object_type, object_id FROM (
  SELECT 0 AS g, o_custkey AS k, 'orders' AS object_type, o_orderkey::VARCHAR AS object_id FROM orders WHERE o_orderstatus = 'F'
  UNION SELECT 0, o_custkey, 'orders', o_orderkey::VARCHAR FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION SELECT 1, c_custkey, 'customer', c_custkey::VARCHAR FROM customer)"""
)
def multi_query_bucket_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries of one group, whose documents overlap, and one of another, as it is routed by another column."""
    rows = stream_of(
        spark, sf_dir, "cust",
        f"{ORDER_DOC} WHERE o_custkey = auth.parameter('c') AND o_orderstatus = 'F'",
        f"{ORDER_DOC} WHERE o_custkey = auth.parameter('c') AND o_orderpriority = '1-URGENT'",
        "SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey = auth.parameter('c')",
    )
    return rows.select("bucket", "object_type", "object_id")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.to_json(F.array(F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)))
    return read_table(spark, sf_dir, "orders").withColumn("tags", tags)


@query("SELECT '1#tagged|0[\"' || t || '\"]' AS bucket, o_orderkey::VARCHAR AS object_id FROM (SELECT o_orderkey, unnest([o_orderstatus, substr(o_orderpriority, 1, 1)]) AS t FROM orders)")
def array_route_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_of(spark, sf_dir, "tagged", "SELECT o_orderkey AS id FROM orders WHERE subscription.parameter('tag') IN tags", extra={"orders": tagged(spark, sf_dir)})
    return rows.select("bucket", "object_id")


# -- predicates --------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey::VARCHAR AS object_id FROM orders WHERE o_orderstatus = 'F'")
def status_filter_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(spark, sf_dir, "o_orderstatus = 'F'")


@query("SELECT o_orderkey::VARCHAR AS object_id FROM orders WHERE nullif(o_orderstatus, 'O') IS NULL AND o_custkey IS NOT NULL")
def null_filter_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nulls = read_table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("O")))
    return matching(spark, sf_dir, "o_orderstatus IS NULL AND o_custkey IS NOT NULL", extra={"orders": nulls})


@query("SELECT o_orderkey::VARCHAR AS object_id FROM orders WHERE (o_orderstatus = 'P' OR o_orderpriority = '2-HIGH') AND (o_custkey = 7 OR o_orderstatus IN ('P', 'F'))")
def or_filter_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(spark, sf_dir, "(o_orderstatus = 'P' OR o_orderpriority = '2-HIGH') AND (o_custkey = 7 OR o_orderstatus IN ('P', 'F'))")


def as_text(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    df = read_table(spark, sf_dir, "orders")
    return {"orders": df.withColumns({"o_custkey": F.col("o_custkey").cast("string"), "done": (F.col("o_orderstatus") == "F").cast("string")})}


@query("SELECT o_orderkey::VARCHAR AS object_id FROM orders WHERE o_custkey::VARCHAR = '5'")
def coercion_string_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(spark, sf_dir, "o_custkey = 5", extra=as_text(spark, sf_dir))


@query("SELECT o_orderkey::VARCHAR AS object_id FROM orders WHERE false")
def coercion_int_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(spark, sf_dir, "5 = o_custkey", extra=as_text(spark, sf_dir))


@query("SELECT o_orderkey::VARCHAR AS object_id FROM orders WHERE o_orderstatus = 'F'")
def coercion_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(spark, sf_dir, "done = true", extra=as_text(spark, sf_dir))


@query("SELECT o_orderkey::VARCHAR AS object_id FROM orders WHERE o_orderstatus = 'P' OR substr(o_orderpriority, 1, 1) = '3'")
def in_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(spark, sf_dir, "'P' IN tags OR '3' IN tags", extra={"orders": tagged(spark, sf_dir)})


@query("SELECT o_orderkey::VARCHAR AS object_id FROM orders WHERE o_orderkey % 100 = o_custkey % 100")
def column_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "orders").withColumns({"a": F.col("o_orderkey") % 100, "b": F.col("o_custkey") % 100})
    return matching(spark, sf_dir, "a = b", extra={"orders": df})


# -- requests and lookups ----------------------------------------------------------------------------------------------


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").cast("string").alias("custkey"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))


@query("""SELECT DISTINCT n_name AS request, '1#orders|0["' || c_custkey || '"]' AS bucket FROM nation JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING'""")
def param_lookup_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request a nation: the buckets of the customers it is a member of."""
    plan = compile_streams([("orders", ["SELECT o_orderkey AS id FROM orders, m AS b WHERE orders.o_custkey = b.custkey"], False)], {"m": "SELECT custkey FROM members WHERE nation = auth.user_id() AND segment = 'BUILDING'"})
    requests = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("request"), F.col("n_nationkey").cast("string").alias("k"))
    found = buckets.lookup_values(plan.lookups()[0], members(spark, sf_dir), requests, ["k"])
    return found.select("request", buckets.bucket_name("orders", 0, [F.col("value")]).alias("bucket")).distinct()


@query("""SELECT n_name AS request, s AS segment, '1#orders|0["' || c_custkey || '"]' AS bucket FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer) JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = s""")
def param_lookup_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = compile_streams([("orders", ["SELECT o_orderkey AS id FROM orders, m AS b WHERE orders.o_custkey = b.custkey"], False)], {"m": "SELECT custkey FROM members WHERE nation = auth.user_id() AND segment = request.jwt() ->> 'segment'"})
    own = members(spark, sf_dir)
    asked = own.select("nation", "segment").distinct()
    requests = read_table(spark, sf_dir, "nation").join(asked, F.col("n_nationkey").cast("string") == F.col("nation")).select(F.col("n_name").alias("request"), "segment", F.col("nation").alias("k"))
    found = buckets.lookup_values(plan.lookups()[0], own, requests, ["k", "segment"])
    return found.select("request", "segment", buckets.bucket_name("orders", 0, [F.col("value")]).alias("bucket"))


@query("""SELECT DISTINCT o_orderkey::VARCHAR AS object_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'""")
def lookup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the buckets that one request resolves to by lookup, by a semi-join."""
    plan = compile_streams([("orders", ["SELECT o_orderkey AS id, o_custkey FROM orders, m AS b WHERE orders.o_custkey = b.custkey"], False)], {"m": "SELECT custkey FROM members WHERE nation = auth.user_id() AND segment = 'BUILDING'"})
    view = buckets.lookup_view(plan.lookups()[0], members(spark, sf_dir)).filter("k0 = '3'").select(buckets.bucket_name("orders", 0, [F.col("value")]).alias("bucket"))
    rows = buckets.plan_rows(plan, {"orders": read_table(spark, sf_dir, "orders")})
    return rows.join(view.distinct(), "bucket", "left_semi").select("object_id")


@query("""SELECT event_id, '1#by_key|0["' || v || '"]' AS bucket FROM (SELECT event_id, unnest([event_type, 'k' || (json_extract(props, '$.k')::INT % 10)]) AS v FROM events)""")
def json_each_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a request with an array of values, which json_each takes apart."""
    plan = compile_streams([("by_key", ["SELECT o_orderkey AS id FROM orders, a WHERE o_orderstatus = a.value"], False)], {"a": "SELECT value FROM json_each(request.parameter_array('v'))"})
    values = F.to_json(F.array("event_type", F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 10).cast("string"))))
    requests = read_table(spark, sf_dir, "events").select("event_id", values.alias("v"))
    return buckets.requested(plan, "by_key", requests, lambda b: F.col(b.name)).select("event_id", "bucket")


@query("""SELECT DISTINCT '1#both|0["' || s || '","' || k || '"]' AS bucket FROM (SELECT unnest(['F', 'O', 'P']) AS s), (SELECT unnest(['1', '2', '3', '4']) AS k)""")
def cartesian_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = compile_streams([("both", ["SELECT o_orderkey AS id FROM orders, a, b WHERE o_orderstatus = a.value AND o_custkey = b.value"], False)], {"a": "SELECT value FROM json_each(request.parameter_array('s'))", "b": "SELECT value FROM json_each(request.parameter_array('k'))"})
    names = buckets.resolve(plan, "both", {"parameters": {"s": ["F", "O", "P"], "k": [1, 2, 3, 4]}})
    return spark.createDataFrame([(n,) for n in names], "bucket string")


@query("SELECT event_id, (event_type = 'click' OR user_id::VARCHAR = '7') AND nullif(props, '') IS NOT NULL AS allowed FROM events")
def request_filter_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = compile_streams([("gated", ["SELECT o_orderkey AS id FROM orders WHERE (auth.parameter('kind') = 'click' OR auth.user_id() = '7') AND connection.parameter('props') IS NOT NULL"], True)])
    columns = {"auth": "event_type", "user_id": "user_id", "connection": "props"}
    requests = read_table(spark, sf_dir, "events")
    test = predicates.request_column(plan.streams[0].queries[0].request_filter, lambda b: F.col(columns[b.kind]).cast("string"))
    return requests.select("event_id", test.alias("allowed"))


# -- change data capture -----------------------------------------------------------------------------------------------


EVENT_JSON = """'{"event":' || event_id || ',"type":"' || event_type || '"}'"""
OPS_SQL = f"""ops AS (
  SELECT row_number() OVER (ORDER BY event_id) AS op_id, CASE WHEN event_type = 'error' THEN 'REMOVE' ELSE 'PUT' END AS op, user_id::VARCHAR AS object_id,
         CASE WHEN event_type <> 'error' THEN {EVENT_JSON} END AS data, CASE WHEN event_type <> 'error' THEN event_type END AS route FROM events),
tail AS (
  SELECT *, lag(data) OVER w AS previous_data, lag(route) OVER w AS previous_route FROM ops WINDOW w AS (PARTITION BY object_id ORDER BY op_id))"""
EFFECTS_SQL = f"""{OPS_SQL},
effects AS (
  SELECT op_id, '1#users|0["' || b || '"]' AS bucket, CASE WHEN route = b THEN 'PUT' ELSE 'REMOVE' END AS effect, object_id,
         CASE WHEN route = b THEN data END AS data, CASE WHEN previous_route = b THEN previous_data END AS previous_data
  FROM (SELECT *, unnest(list_distinct(list_filter([route, previous_route], lambda x: x IS NOT NULL))) AS b FROM tail))"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    doc = render.document(e, [("event", e["event_id"]), ("type", e["event_type"])])
    gone = F.col("event_type") == "error"
    none = F.lit(None).cast("string")
    return e.select(F.col("event_id").alias("lsn"), F.lit(0).alias("seq"), F.when(gone, "delete").otherwise("insert").alias("kind"), F.lit("users").alias("object_type"), F.col("user_id").cast("string").alias("object_id"), F.when(~gone, doc).alias("data"), F.when(~gone, F.col("event_type")).alias("route"), none.alias("old_id"), none.alias("old_route"))


def ops_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.with_op_ids(cdc.derive(changes(spark, sf_dir)))


def tail_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.enrich(ops_of(spark, sf_dir))


def bucket_of(route):
    return buckets.bucket_name("users", 0, [route])


def effects_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.effects(tail_of(spark, sf_dir), bucket_of)


def rows_of(ops: DataFrame) -> DataFrame:
    return cdc.latest(ops).select(bucket_of(F.col("route")).alias("bucket"), "object_type", "object_id", "data")


def current_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(ops_of(spark, sf_dir))


@query(f"WITH {OPS_SQL} SELECT op_id, op, object_id, data FROM ops")
def cdc_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops_of(spark, sf_dir).select("op_id", "op", "object_id", "data")


@query(f"WITH {OPS_SQL} SELECT op_id, previous_data, previous_route FROM tail")
def cdc_previous_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail_of(spark, sf_dir).select("op_id", "previous_data", "previous_route")


@query(f"WITH {OPS_SQL} SELECT object_id, data FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY op_id DESC) AS n FROM ops) WHERE n = 1 AND op = 'PUT'")
def cdc_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(spark, sf_dir).select("object_id", "data")


@query(f"WITH {EFFECTS_SQL} SELECT op_id, bucket, effect FROM effects")
def cdc_bucket_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects_of(spark, sf_dir).select("op_id", "bucket", "effect")


ENTRY_SQL = f"CASE WHEN effect = 'PUT' THEN {put_sql("'users'", 'object_id', 'data')} ELSE {remove_sql("'users'", 'object_id')} END"


@query(f"WITH {EFFECTS_SQL} SELECT bucket, count(*) AS count, {signed_sum(ENTRY_SQL)} AS checksum FROM effects GROUP BY bucket")
def cdc_superseded_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current documents plus what is superseded; the SQL sums what was ever sent, which must be the same."""
    ops = ops_of(spark, sf_dir)  # settled: both sides read it
    return cdc.checkpoint(cdc.current_checkpoint(rows_of(ops)), cdc.superseded_checkpoint(cdc.effects(cdc.enrich(ops), bucket_of)))


@query("SELECT count(*) AS ops, count(DISTINCT event_id) AS lsns FROM events")
def redelivery_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half is applied, then everything is delivered again."""
    all_ = changes(spark, sf_dir)
    half = all_.agg(F.max("lsn")).first()[0] // 2
    first = all_.filter(F.col("lsn") <= half)
    again = cdc.not_yet_applied(all_, half)
    return cdc.derive(first.unionByName(again)).agg(F.count(F.lit(1)).alias("ops"), F.countDistinct("lsn").alias("lsns"))


@query(f"WITH {OPS_SQL} SELECT op_id, op FROM ops WHERE op_id > (SELECT count(*) FROM events) - 500")
def tail_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = tail_of(spark, sf_dir)
    return cdc.retained(tail, read_table(spark, sf_dir, "events").count(), 500).select("op_id", "op")


@query("SELECT user_id::VARCHAR AS id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) FILTER (WHERE event_id % 3 = 0) AS value FROM events GROUP BY user_id")
def lookup_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change carries value only every third time; otherwise the last value stays."""
    e = read_table(spark, sf_dir, "events")
    given = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("kind"), F.lit("value"))).otherwise(F.array(F.lit("kind")))
    rows = e.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("lsn"), F.lit(0).alias("seq"), given.alias("present"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    return cdc.carry_forward(rows, ["kind", "value"])


@query("SELECT user_id AS xid, count(*) AS n_changes FROM events GROUP BY user_id")
def transaction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as one transaction, between its begin and commit."""
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("xid"), F.col("event_id").alias("seq"), F.lit("insert").alias("kind"))
    ends = e.select("xid").distinct().select("xid", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("seq"), F.lit("begin").alias("kind")), F.struct(F.lit(1 << 60).alias("seq"), F.lit("commit").alias("kind")))).alias("x")).select("xid", "x.*")
    return cdc.check_transactions(e.unionByName(ends))


# -- serving -----------------------------------------------------------------------------------------------------------


@query("""SELECT user_id AS bucket, event_id AS after, CASE WHEN event_id = 0 THEN 'snapshot' WHEN event_id > 9000 OR event_id < 2000 THEN 'reset' ELSE 'delta' END AS mode FROM events""")
def cursor_reset_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursors = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("bucket"), F.col("event_id").alias("after"))
    return serve.decide(cursors, 9000, 1500, 2000)


@query(f"WITH {EFFECTS_SQL} SELECT op_id, bucket, effect AS op, object_id, data FROM effects WHERE op_id > (SELECT count(*) // 2 FROM events)")
def delta_since_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "events").count()
    found = effects_of(spark, sf_dir)
    cursors = serve.decide(found.select("bucket").distinct().withColumn("after", F.lit(n // 2)), n, 0, 0)
    return serve.delta_entries(found, cursors).select("op_id", "bucket", "op", "object_id", "data")


def customer_snapshot(spark: SparkSession, sf_dir: str, after: int | None) -> tuple[DataFrame, DataFrame, int]:
    rows = stream_of(spark, sf_dir, "orders", f"{ORDER_DOC} WHERE o_orderstatus = auth.parameter('s')")
    cursors = serve.decide(rows.select("bucket").distinct().withColumn("after", F.lit(after).cast("long")), 20_000, 0, 100 if after else 0)
    return rows, cursors, 20_000


@query("""SELECT '1#orders|0["' || o_orderstatus || '"]' AS bucket, o_orderkey::VARCHAR AS object_id,
  20000 - count(*) OVER (PARTITION BY o_orderstatus) + row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey::VARCHAR) AS op_id FROM orders""")
def snapshot_op_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cursors, last = customer_snapshot(spark, sf_dir, None)
    return serve.snapshot_entries(rows, cursors, last).select("bucket", "object_id", "op_id")


@query(f"""WITH {EFFECTS_SQL},
sent AS (SELECT bucket, sum({ENTRY_SQL}) AS t FROM effects GROUP BY bucket),
docs AS (SELECT '1#users|0["' || route || '"]' AS bucket, sum({put_sql("'users'", 'object_id', 'data')}) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY op_id DESC) AS n FROM ops) WHERE n = 1 AND op = 'PUT' GROUP BY route)
SELECT bucket, ((sent.t - coalesce(docs.t, 0))::HUGEINT % 4294967296)::BIGINT AS checksum FROM sent LEFT JOIN docs USING (bucket) WHERE (sent.t - coalesce(docs.t, 0))::HUGEINT % 4294967296 <> 0""")
def clear_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What CLEAR carries for clients that begin anew: all that was ever sent, less the current documents."""
    found = effects_of(spark, sf_dir)
    cursors = serve.decide(found.select("bucket").distinct().withColumn("after", F.lit(None).cast("long")), 1 << 40, 0, 0)
    entries = serve.snapshot_entries(current_rows(spark, sf_dir), cursors, 1 << 40, cdc.superseded_checkpoint(found))
    return entries.filter("op = 'CLEAR'").select("bucket", "checksum")


PAGES_SQL = """n AS (SELECT s, count(*) {extra} AS n FROM (SELECT o_orderstatus AS s FROM orders) GROUP BY s),
pages AS (SELECT s, n, unnest(range(0, (n + 255) // 256)) AS page FROM n)
SELECT '1#orders|0["' || s || '"]' AS bucket, page, least(n, (page + 1) * 256) - page * 256 AS n,
  CASE WHEN page = 0 THEN 0 ELSE 20000 - n + page * 256 END AS after, 20000 - n + least(n, (page + 1) * 256) AS next_after, (page + 1) * 256 < n AS has_more FROM pages"""


@query("WITH " + PAGES_SQL.format(extra=""))
def snapshot_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cursors, last = customer_snapshot(spark, sf_dir, None)
    return serve.pages(serve.snapshot_entries(rows, cursors, last), cursors).select("bucket", "page", "n", "after", "next_after", "has_more")


@query("WITH " + PAGES_SQL.format(extra="+ 1"))
def reset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor below the floor: CLEAR takes a place before the documents."""
    rows, cursors, last = customer_snapshot(spark, sf_dir, 50)
    return serve.pages(serve.snapshot_entries(rows, cursors, last), cursors).select("bucket", "page", "n", "after", "next_after", "has_more")


@query(f"""WITH {EFFECTS_SQL},
since AS (SELECT bucket, op_id, (row_number() OVER (PARTITION BY bucket ORDER BY op_id) - 1) // 256 AS page FROM effects WHERE op_id > 100),
per AS (SELECT bucket, page, count(*) AS n, max(op_id) AS next_after FROM since GROUP BY bucket, page)
SELECT bucket, page, n, coalesce(lag(next_after) OVER w, 100) AS after, next_after, lead(page) OVER w IS NOT NULL AS has_more FROM per WINDOW w AS (PARTITION BY bucket ORDER BY page)""")
def delta_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = effects_of(spark, sf_dir)
    cursors = serve.decide(found.select("bucket").distinct().withColumn("after", F.lit(100)), 1 << 40, 0, 0)
    return serve.pages(serve.delta_entries(found, cursors), cursors).select("bucket", "page", "n", "after", "next_after", "has_more")


REGION_JSON = """'{"id":' || r_regionkey || ',"r_name":"' || r_name || '"}'"""


@query(f"""WITH d AS (SELECT r_regionkey::VARCHAR AS id, {REGION_JSON} AS data, row_number() OVER (ORDER BY r_regionkey::VARCHAR) AS n, count(*) OVER () AS c FROM region),
s AS (SELECT *, {put_sql("'region'", "id", "data")} AS ck FROM d)
SELECT 0::BIGINT AS line_no, 'checkpoint' AS kind, '{{"checkpoint":{{"last_op_id":"100","write_checkpoint":null,"buckets":[{{"bucket":"1#regions|0[]","checksum":' || {signed_sum("ck")} || ',"count":' || count(*) || ',"priority":3,"subscriptions":[{{"default":0}}]}}],"streams":[{{"name":"regions","is_default":true,"errors":[]}}]}}}}' AS json FROM s
UNION ALL SELECT 1, 'data', '{{"data":{{"bucket":"1#regions|0[]","data":[' || string_agg('{{"op_id":"' || (100 - c + n) || '","op":"PUT","object_type":"region","object_id":"' || id || '","data":' || to_json(data) || ',"checksum":' || ck || ',"subkey":"region/' || id || '"}}', ',' ORDER BY n) || '],"has_more":false,"after":"0","next_after":"100"}}}}' FROM s
UNION ALL SELECT 2, 'checkpoint_complete', '{{"checkpoint_complete":{{"last_op_id":"100"}}}}'""")
def protocol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_of(spark, sf_dir, "regions", "SELECT r_regionkey AS id, r_name FROM region")
    cursors = serve.decide(spark.createDataFrame([("1#regions|0[]", None)], "bucket string, after long"), 100, 0, 0)
    entries = serve.snapshot_entries(rows, cursors, 100)
    return serve.lines(cdc.checkpoint(cdc.current_checkpoint(rows)), entries, cursors, 100).select("line_no", "kind", "json")


# -- rendering, checksums, statistics ----------------------------------------------------------------------------------


@query("""SELECT o_orderkey, '{"at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') || '"}' AS json, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS from_text FROM orders""")
def timestamp_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss+00")
    return o.select("o_orderkey", render.document(o, [("at", o["o_orderdate"])]).alias("json"), render.timestamp_from_text(text).alias("from_text"))


@query("""SELECT o_orderkey, '{"price":' || o_totalprice || ',"key":' || o_custkey || ',"big":' || (o_orderkey::DOUBLE * 10000000) || '}' AS json, o_totalprice::VARCHAR AS from_text FROM orders""")
def number_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    fields = [("price", o["o_totalprice"]), ("key", o["o_custkey"]), ("big", o["o_orderkey"].cast("double") * 10000000)]
    return o.select("o_orderkey", render.document(o, fields).alias("json"), render.number_from_text(F.col("o_totalprice").cast("string")).alias("from_text"))


@query(f"SELECT o_orderkey, {put_sql("'orders'", 'o_orderkey', ORDER_JSON)} AS put, {remove_sql("'orders'", 'o_orderkey')} AS remove FROM orders")
def put_remove_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    doc = render.document(o, [("id", o["o_orderkey"]), ("o_custkey", o["o_custkey"]), ("o_orderstatus", o["o_orderstatus"])])
    key = F.col("o_orderkey").cast("string")
    return o.select("o_orderkey", render.put_checksum(F.lit("orders"), key, doc).alias("put"), render.remove_checksum(F.concat(F.lit("orders/"), key)).alias("remove"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type")
def metrics_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.count(F.lit(1)).alias("n"))


@query("SELECT r_name, sha256(string_agg(n_name, chr(10) ORDER BY n_name)) AS digest FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def record_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "nation", "region")
    joined = t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").cast("binary"), 256).alias("digest"))


@query("""SELECT event_id, printf('%X/%X', (event_id * 1000003) // 4294967296, (event_id * 1000003) % 4294967296) AS lsn, event_id * 1000003 AS back FROM events""")
def lsn_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").withColumn("v", F.col("event_id") * 1000003)
    return e.select("event_id", render.lsn_text(F.col("v")).alias("lsn"), render.lsn_value(render.lsn_text(F.col("v"))).alias("back"))


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY event_id) - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM events)
SELECT event_type, len, count(*) AS runs FROM (SELECT event_type, run, count(*) AS len FROM r GROUP BY event_type, run) GROUP BY event_type, len""")
def run_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of runs of equal event types; event_id is dense, so a run begins where the event before it differs. A
    run ends where the next begins: in its own range of starts, or at the first start of a later range."""
    e = read_table(spark, sf_dir, "events")
    before = e.select((F.col("event_id") + 1).alias("event_id"), F.col("event_type").alias("was"))
    starts = e.join(before, "event_id", "left").filter("was is null or was != event_type").select("event_id", "event_type")
    kept, sizes = cdc.in_order(starts, "event_id")
    heads = {r["part"]: r["head"] for r in kept.groupBy("part").agg(F.min("event_id").alias("head")).collect()}  # a row a partition
    end = e.agg(F.max("event_id")).first()[0]
    ends = {part: after for (part, _), after in zip(sizes, [heads[p] for p, _ in sizes[1:]] + [(end or 0) + 1], strict=True)} if sizes else {0: 0}
    last = F.element_at(F.create_map(*[F.lit(x) for kv in ends.items() for x in kv]), F.col("part"))
    upto = F.coalesce(F.lead("event_id").over(Window.partitionBy("part").orderBy("event_id")), last)
    return kept.select("event_type", (upto - F.col("event_id")).alias("len")).groupBy("event_type", "len").agg(F.count(F.lit(1)).alias("runs"))


TASKS_SQL = """WITH n AS (
  SELECT i // 120 + 1 AS o, (i // 20) % 6 + 1 AS p, i % 20 + 1 AS t FROM range(360) AS r(i)),
ids AS (SELECT *, 'org-' || lpad(o::VARCHAR, 3, '0') AS org_id, lpad(p::VARCHAR, 4, '0') AS pp, lpad(t::VARCHAR, 4, '0') AS tt FROM n)
SELECT 'task-' || org_id || '-' || pp || '-' || tt AS id, org_id, 'project-' || org_id || '-' || pp AS project_id, 'user-1' AS owner_id, 'Task ' || p || '.' || t AS title,
       CASE WHEN t % 7 = 0 THEN 'blocked' WHEN t % 5 = 0 THEN 'done' WHEN t % 3 = 0 THEN 'in_progress' ELSE 'todo' END AS status, ((t - 1) % 5 + 1)::INT AS priority,
       'user-' || org_id || '-' || lpad(((p + t - 2) % 8 + 1)::VARCHAR, 4, '0') AS assignee_id, ((t - 1) % 8 + 1)::INT AS story_points, '2026-01-01T00:00:00Z' AS updated_at,
       repeat(md5(org_id || ':' || p || ':' || t), 3) AS summary
FROM ids"""


@query(TASKS_SQL)
def fixture_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated task table of a load test, three organisations of six projects with twenty tasks."""
    return fixtures.tasks(spark, 3, 8, 6, 20)
