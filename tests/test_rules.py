"""The rule compiler: what compiles, what it means, and what is refused."""

import pytest
from pyspark.sql import functions as F

from tributary.functions import render
from tributary.operators import buckets, predicates, serve
from tributary.plans.compiler import compile_query, compile_rules, compile_streams, load_rules
from tributary.plans.explain import explain
from tributary.plans.model import Binding, Literal, RuleError
from tributary.sources import tables

REFUSED = [
    "SELECT * FROM t WHERE a > 1",
    "SELECT * FROM t WHERE a != 'x'",
    "SELECT * FROM t WHERE a LIKE 'x'",
    "SELECT * FROM t WHERE a = 1.5",
    "SELECT * FROM t WHERE NOT a = 1",
    "SELECT * FROM other.t",
    "SELECT * FROM t JOIN u",
    "SELECT * FROM t ORDER BY a",
    "SELECT * FROM t LIMIT 3",
    "SELECT * FROM t, u WHERE t.a = u.a",
    "SELECT * FROM t WHERE a = auth.parameter('x') OR b = auth.parameter('y')",
    "SELECT * FROM t WHERE a > auth.parameter('x')",
    "SELECT a, a FROM t",
    "SELECT a || 'x' FROM t",
    "SELECT * FROM t WHERE 5 IS NULL",
    "SELECT * FROM t WHERE a = auth.unknown('x')",
]


@pytest.mark.parametrize("text", REFUSED)
def test_refused(text):
    with pytest.raises(RuleError):
        compile_query(text)


def test_forms():
    q = compile_query("""SELECT "a b" AS id, x.c || ' WHERE = ' || d AS e FROM public.t AS x WHERE auth.user_id() = owner AND c IN ('p', 'q''s') AND request.parameters() ->> 'k' = 'v'""")
    assert q.parameters[0].column == "owner" and q.parameters[0].binding == Binding("user_id")
    assert q.row_filter.right == (Literal("p"), Literal("q's"))
    assert q.request_filter.left == Binding("request", "k")
    assert q.projection.outputs[1].parts[1] == Literal(" WHERE = ")


def test_yaml_and_refusals():
    plan = compile_rules("edition: 3\nwith:\n  m: SELECT org FROM members WHERE uid = auth.user_id()\nstreams:\n  s:\n    query: SELECT * FROM t, m AS b WHERE t.org = b.org\n  d:\n    auto_subscribe: true\n    queries:\n      - SELECT * FROM t\n      - SELECT id AS other FROM t\n")
    assert plan.lookups()[0].keys == (("uid", Binding("user_id")),)
    assert len(plan.stream("d").groups()) == 1 and len(plan.contract_id) == 16
    for bad in ("storage_version: 2\nstreams:\n  s:\n    query: SELECT * FROM t\n", "streams: {}\n", "streams:\n  s:\n    queries: []\n", "streams:\n  s:\n    limit: 1\n    query: SELECT * FROM t\n"):
        with pytest.raises(RuleError):
            compile_rules(bad)
    for cte in ("SELECT a, b FROM m WHERE u = auth.user_id()", "SELECT a FROM m", "SELECT a FROM m WHERE u = auth.user_id() OR v = 'x'", "SELECT a FROM m WHERE u = auth.user_id() AND u = auth.parameter('z')", "SELECT a FROM m WHERE u = auth.user_id() AND n = 5"):
        with pytest.raises(RuleError):
            compile_query("SELECT * FROM t, c WHERE t.a = c.a", {"c": cte})


def test_bucket_names():
    name = buckets.bucket_text("s", 1, ["a", 'q"é'])
    assert name == '1#s|1["a","q\\"é"]' and buckets.parse_bucket(name) == ("s", 1, ["a", 'q"é'])
    for bad in ("s", "1#s|0[1]", "1#s|0[", "2#s|0[]"):
        with pytest.raises(RuleError):
            buckets.parse_bucket(bad)


def test_requests():
    plan = compile_streams([("s", ["SELECT * FROM t WHERE a = auth.parameter('org') AND b IN request.parameter_array('bs') AND connection.parameter('on') = 'y'"], False)])
    request = {"auth": {"org": 5}, "parameters": {"bs": '["x","y"]', "on": "y", "org": "spoofed"}}
    assert buckets.resolve(plan, "s", request) == ['1#s|0["5","x"]', '1#s|0["5","y"]']
    assert buckets.resolve(plan, "s", {**request, "parameters": {"bs": ["x"], "on": ""}}) == []
    p = compile_query("SELECT * FROM t WHERE auth.parameter('x') IS NULL").request_filter
    assert predicates.request_predicate(p, {"auth": {"x": ""}}) and not predicates.request_predicate(p, {"auth": {"x": "v"}})


def test_vectors(spark):
    one = spark.range(1)
    put = render.put_checksum(F.lit("tasks"), F.lit("task-1"), F.lit('{"id":"task-1"}'))
    gone = render.remove_checksum(F.lit("tasks/task-1"))
    assert one.select(put, gone, render.signed(put)).first()[:] == (2230509878, 1514895139, -2064457418)
    assert one.select(render.signed(render.wrapped(F.lit(6000000000)))).first()[0] == 1705032704


def test_rendering(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00+00", "1", "0.000001", "t", '{"b":1,"a":[]}', "x\"é", None)], "ts string, n string, f string, b string, j string, s string, z string")
    got = df.select(render.timestamp_from_text(F.col("ts")), render.number_from_text(F.col("n")), render.number_from_text(F.col("f")), render.boolean_from_text(F.col("b")), render.json_from_text(F.col("j")), render.document(df, [("s", df["s"]), ("z", df["z"])])).first()
    assert got[:] == ("2026-01-01T00:00:00.000000Z", "1", "1e-6", "true", '{"a":[],"b":1}', '{"s":"x\\"é","z":null}')
    numbers = [1.0, 0.1, 1e7, 12345678.5, 1e15, 1e16, 0.001, 1e-5, -2.5e20]
    texts = [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(render.number_text(F.col("x"))).collect()]
    assert texts == ["1.0", "0.1", "10000000.0", "12345678.5", "1000000000000000.0", "1e16", "0.001", "0.00001", "-2.5e20"]


def test_null_route_is_an_error(spark):
    plan = compile_streams([("s", ["SELECT id, a FROM t WHERE a = auth.parameter('x')"], False)])
    rows = spark.createDataFrame([(1, None)], "id long, a string")
    with pytest.raises(Exception, match="routes a document"):
        buckets.plan_rows(plan, {"t": rows}).collect()
    with pytest.raises(RuleError, match="no column"):
        buckets.plan_rows(plan, {"t": rows.drop("a")})


def test_explain_compiles_to_the_same_plan():
    text = "with:\n  m: SELECT org FROM members WHERE uid = auth.user_id() AND kind = 'x' AND left_at IS NULL\n  e: SELECT value FROM json_each(request.parameter_array('ids'))\nstreams:\n" + "".join(
        f"  s{i}:\n    auto_subscribe: {'true' if i % 2 else 'false'}\n    query: {q}\n"
        for i, q in enumerate(
            [
                "SELECT * FROM t",
                "SELECT *, a || ' ''q'' ' || b AS c FROM t WHERE a = 'x' AND (b IN ('p', 'q') OR c IS NOT NULL)",
                "SELECT id, b FROM u WHERE owner = auth.user_id() AND n = 5 AND ok = TRUE",
                "SELECT * FROM t, m AS b WHERE t.org = b.org AND request.jwt() ->> 'role' = 'admin'",
                "SELECT * FROM t, e WHERE t.k = e.value",
                "SELECT * FROM t WHERE subscription.parameter('tag') IN tags AND connection.parameter('v') IS NULL",
            ]
        )
    )
    plan = compile_rules(text)
    shown = explain(plan)
    again = [[compile_query(q["sql"], q["with"]) for g in s["groups"] for q in g["queries"]] for s in shown["streams"]]
    assert again == [list(s.queries) for s in plan.streams]
    assert shown["tables"]["t"]["all_columns"] and shown["tables"]["u"]["columns"] == ["id", "b"] and len(shown["lookups"]) == 1


def test_sources_are_checked_before_use(spark):
    plan = compile_rules("with:\n  m: SELECT org FROM members WHERE uid = auth.user_id()\nstreams:\n  s:\n    query: SELECT * FROM t, m AS b WHERE t.org = b.org\n")
    whole = {"operations": ["insert", "update", "delete", "truncate"]}
    tables.check_publication(plan, {"t": whole, "members": whole})
    for broken in ({"t": whole}, {"t": whole, "members": {"operations": ["insert"]}}, *({"t": whole | {k: v}, "members": whole} for k, v in (("omitted", ["c"]), ("row_filter", "x"), ("parent", True), ("via_root", True)))):
        with pytest.raises(RuleError):
            tables.check_publication(plan, broken)
    tables.check_start(5, 5)
    tables.check_start(5, None)
    for start, durable, active in ((6, 5, False), (1, 5, True)):
        with pytest.raises(RuleError):
            tables.check_start(start, durable, active)
    with pytest.raises(RuleError, match="verify-full or disable"):
        tables.read_jdbc(spark, "jdbc:x", "t", tls="prefer")
    with pytest.raises(RuleError, match="not supported"):
        tables.read_table(spark, "/nowhere", "t", "xml")
    with pytest.raises(RuleError, match="no column z"):
        tables.check_columns(spark.range(1), ["id", "z"])


def test_rules_come_from_several_places(tmp_path, monkeypatch):
    rules = lambda name: f"streams:\n  {name}:\n    query: SELECT * FROM t\n"
    named = lambda **k: load_rules(**k).streams[0].name
    for k in ("TRIBUTARY_RULES", "TRIBUTARY_RULES_PATH"):
        monkeypatch.delenv(k, raising=False)
    (tmp_path / "a").write_text(rules("file"))
    assert named(text=rules("text"), path=str(tmp_path / "a")) == "text" and named(path=str(tmp_path / "a"), builtin=rules("own")) == "file" and named(builtin=rules("own")) == "own"
    with pytest.raises(RuleError, match="no rules"):
        load_rules()
    monkeypatch.setenv("TRIBUTARY_RULES_PATH", str(tmp_path / "a"))
    assert named(builtin=rules("own")) == "file"
    monkeypatch.setenv("TRIBUTARY_RULES", rules("env"))
    assert named(builtin=rules("own")) == "env"


def test_lookup_ids_and_cursors(spark):
    text = "with:\n  m: SELECT org FROM members WHERE uid = auth.user_id(){}\nstreams:\n  s:\n    query: SELECT * FROM t, m AS b WHERE t.org = b.org\n"
    one, same, other = (compile_rules(text.format(x)).lookups()[0].lookup_id for x in ("", "", " AND kind = 'x'"))
    assert one == same != other and len(one) == 16
    cursors = spark.createDataFrame([("a", 0), ("b", 7)], "bucket string, after long")
    assert {tuple(r) for r in serve.advance(cursors, 9).collect()} == {("a", 9), ("b", 9)}
    assert {(r.bucket, r.mode) for r in serve.decide(cursors, 9, 3, 8).collect()} == {("a", "snapshot"), ("b", "reset")}
