"""Incremental state equals state rebuilt; redelivery, retention, restart."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import cdc
from tributary.plans.model import RuleError
from tributary.streaming import runner
from tributary.streaming.store import Store, WriteConflict, slot_column, slot_of

CHANGE = "lsn long, seq int, kind string, object_type string, object_id string, data string, route string, old_id string, old_route string"


def change(lsn, kind, ident, data=None, route=None, old_id=None, old_route=None, seq=0):
    return (lsn, seq, kind, "t", ident, data, route, old_id, old_route)


def random_changes(seed, n=60):
    rng = random.Random(seed)
    out = []
    for lsn in range(1, n + 1):
        ident = f"k{rng.randrange(6)}"
        if rng.random() < 0.25:
            out.append(change(lsn, "delete", ident))
        else:
            out.append(change(lsn, "insert", ident, f'{{"v":{lsn}}}', rng.choice("abc")))
    return out


def entries_checkpoint(effects):
    rows = effects.select("bucket", cdc.entry_checksum().alias("checksum"))
    return cdc.checkpoint(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), F.sum("checksum").alias("checksum")))


def as_set(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_incremental_equals_rebuild(spark, tmp_path, seed):
    rows = random_changes(seed)
    store = Store(spark, f"file://{tmp_path}/s", "c")
    store.snapshot(spark.createDataFrame([], "object_type string, object_id string, data string, route string"), 0)
    for a in range(0, len(rows), 20):
        store.apply(spark.createDataFrame(rows[a : a + 20], CHANGE))
    m = store.apply(spark.createDataFrame(rows[10:30], CHANGE))  # delivered again
    assert m.last_lsn == len(rows) and m.last_op_id == len(rows)
    ops = cdc.with_op_ids(cdc.derive(spark.createDataFrame(rows, CHANGE)))
    keep = ["object_type", "object_id", "data", "route"]
    assert as_set(store.table("current").select(keep)) == as_set(cdc.latest(ops).select(keep))
    assert as_set(store.table("tail").select("op_id", "previous_data", "previous_route")) == as_set(cdc.enrich(ops).select("op_id", "previous_data", "previous_route"))
    found = cdc.effects(store.table("tail"), lambda r: r)
    docs = store.table("current").select(F.col("route").alias("bucket"), "object_type", "object_id", "data")
    assert as_set(cdc.checkpoint(cdc.current_checkpoint(docs), cdc.superseded_checkpoint(found))) == as_set(entries_checkpoint(found))


def test_retention_and_contract(spark, tmp_path):
    uri = f"file://{tmp_path}/s"
    store = Store(spark, uri, "c", keep=2)
    assert store.open() is None
    with pytest.raises(RuleError):
        store.apply(spark.createDataFrame([change(1, "insert", "a", "{}", "r")], CHANGE))
    store.snapshot(spark.createDataFrame([("t", "z", "{}", "r")], "object_type string, object_id string, data string, route string"), 0)
    m = store.apply(spark.createDataFrame([change(i, "insert", f"k{i}", "{}", "r") for i in range(1, 6)], CHANGE))
    assert m.last_op_id == 6 and m.retained_floor == 4 and store.table("tail").count() == 2
    assert store.open() == store.manifest() and Store(spark, uri, "other").open() is None
    again = store.snapshot(spark.createDataFrame([("t", "z", "{}", "r")], "object_type string, object_id string, data string, route string"), 9)
    assert again.snapshot_floor > m.last_op_id
    assert store.clear("t").last_op_id > again.last_op_id and store.table("current").count() == 0


DOC = "object_type string, object_id string, data string, route string"


def test_slots(spark):
    names = ["", "a", "é漢", '1#own|0["u1"]', *(f"b{i}" for i in range(50))]
    df = spark.createDataFrame([(n,) for n in [*names, None]], "n string")
    assert {r.n: r.s for r in df.select("n", slot_column(F.col("n"), 64).alias("s")).collect()} == {n: slot_of(n, 64) for n in [*names, None]}


def test_only_touched_slots_are_rewritten(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "c", slots=16)
    docs = [("t", f"k{i}", f'{{"v":{i}}}', f"b{i % 40}") for i in range(400)]
    first = store.snapshot(spark.createDataFrame(docs, DOC), 0)
    m = store.apply(spark.createDataFrame([change(1, "insert", "k0", '{"v":-1}', "b7"), change(2, "delete", "k5"), change(3, "insert", "new", "{}", "b7")], CHANGE))
    touched = {slot_of(b, 16) for b in ("b0", "b5", "b7")}
    kept = {p for p in first.paths["current"] if int(p.rsplit("=", 1)[1]) not in touched}
    assert kept <= set(m.paths["current"]) and len(set(m.paths["current"]) - kept) <= len(touched) and store.counters["rewritten_slots"] == len(touched)
    want = {(k, d, r) for _, k, d, r in docs if k not in ("k0", "k5")} | {("k0", '{"v":-1}', "b7"), ("new", "{}", "b7")}
    assert as_set(store.table("current").select("object_id", "data", "route")) == want
    own = store.table("current").withColumn("bucket", F.col("route"))
    assert as_set(store.table("sums").select("bucket", "count", "checksum")) == as_set(cdc.current_checkpoint(own))
    near = store.current(["b7"], m)
    assert near.filter("route = 'b7'").count() == 12 and near.count() < 400
    assert {len(near.inputFiles()) > 0, len(near.inputFiles()) < len(store.table("current").inputFiles())} == {True}


def test_concurrent_writers(spark, tmp_path, monkeypatch):
    """The second of two writers from one state is told, and loses nothing by trying again."""
    one, two = (Store(spark, f"file://{tmp_path}/s", "c") for _ in range(2))
    one.snapshot(spark.createDataFrame([("t", "z", "{}", "r")], DOC), 0)
    old = two.manifest()
    one.apply(spark.createDataFrame([change(1, "insert", "a", "{}", "r")], CHANGE))
    with monkeypatch.context() as patched:
        patched.setattr(two, "manifest", lambda: old)
        with pytest.raises(WriteConflict):
            two.apply(spark.createDataFrame([change(2, "insert", "b", "{}", "r")], CHANGE))
    assert two.counters["conflicts"] == 1
    two.apply(spark.createDataFrame([change(2, "insert", "b", "{}", "r")], CHANGE))
    assert {r.object_id for r in one.table("current").collect()} == {"z", "a", "b"} and one.manifest().last_op_id == old.last_op_id + 2


def test_old_generations_go(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "c", old_seconds=0.0)
    store.snapshot(spark.createDataFrame([("t", f"z{i}", "{}", f"r{i}") for i in range(20)], DOC), 0)
    for lsn in range(1, 4):
        store.apply(spark.createDataFrame([change(lsn, "insert", "a", f'{{"v":{lsn}}}', "r1")], CHANGE))
    (tmp_path / "s" / "generation=99-abandoned").mkdir()  # a writer's that has not committed
    store.prune()
    left = {x.name for x in (tmp_path / "s").iterdir() if x.name.startswith("generation=")}
    named = {p.split("/s/")[1].split("/")[0] for ps in store.manifest().paths.values() for p in ps}
    assert left == named | {"generation=99-abandoned"} and len(list((tmp_path / "s" / "manifests").glob("*.json"))) == 1
    assert store.table("current").count() == 21 and store.table("tail").count() == 3


def test_interrupted_snapshot_is_seen(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "c")
    first = store.snapshot(spark.createDataFrame([("t", "z", "{}", "r")], DOC), 0)
    broken = spark.createDataFrame([("t", "z", "{}", "r")], DOC).withColumn("data", F.raise_error(F.lit("source is gone")).cast("string"))
    with pytest.raises(Exception, match="source is gone"):
        store.snapshot(broken, 5)
    assert not store.manifest().complete and store.open() is None
    with pytest.raises(RuleError, match="no snapshot"):
        store.apply(spark.createDataFrame([change(9, "insert", "a", "{}", "r")], CHANGE))
    again = store.snapshot(spark.createDataFrame([("t", "z", "{}", "r")], DOC), 5)
    assert again.complete and again.snapshot_floor > first.last_op_id and store.open() == store.manifest()
    with pytest.raises(RuleError, match="another contract"):
        Store(spark, store.uri, "other").apply(spark.createDataFrame([change(9, "insert", "a", "{}", "r")], CHANGE))


def test_update_and_truncate(spark):
    ops = cdc.derive(spark.createDataFrame([change(1, "update", "b", "{}", "r", old_id="a", old_route="q"), change(2, "update", "b", "{}", "s")], CHANGE))
    assert [(r.op, r.object_id, r.route) for r in ops.orderBy(*cdc.ORDER).collect()] == [("REMOVE", "a", "q"), ("PUT", "b", "r"), ("PUT", "b", "s")]
    with pytest.raises(Exception, match="truncate"):
        cdc.derive(spark.createDataFrame([change(1, "truncate", None)], CHANGE)).collect()


def test_broken_transaction(spark):
    rows = [(1, 1, "begin"), (1, 2, "insert")]
    with pytest.raises(Exception, match="not whole"):
        cdc.check_transactions(spark.createDataFrame(rows, "xid long, seq long, kind string")).collect()


def test_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "c")
    store.snapshot(spark.createDataFrame([], "object_type string, object_id string, data string, route string"), 0)
    source = str(tmp_path / "in")
    for part in (random_changes(3)[:30], random_changes(3)[30:]):
        spark.createDataFrame(part, CHANGE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(CHANGE).parquet(source)
        runner.supervise(lambda s=stream: runner.start(s, store, str(tmp_path / "cp")), attempts=1)
    assert store.manifest().last_lsn == 60
    assert runner.wait_for_change(store, 0, 1) and not runner.wait_for_change(store, 1 << 50, 0.3)


def test_lookup_carry_forward(spark):
    rows = [("1", 1, 0, ["a", "b"], "x", "y"), ("1", 2, 0, ["a"], "z", None), ("2", 1, 0, ["b"], None, None)]
    df = spark.createDataFrame(rows, "id string, lsn long, seq int, present array<string>, a string, b string")
    stored = spark.createDataFrame([("2", "old", "q"), ("3", "k", "l")], "id string, a string, b string")
    assert as_set(cdc.carry_forward(df, ["a", "b"], stored)) == {("1", "z", "y"), ("2", "old", None), ("3", "k", "l")}


LOOKUP_CHANGE = "id string, lsn long, seq int, kind string, old_id string, present array<string>, org string, uid string"


def test_lookup_rows_are_in_the_same_commit(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "c", raw=True)
    rows = spark.createDataFrame([("1", "o1", "u1"), ("2", "o2", "u1"), ("3", "o3", "u2"), ("4", "o4", "u4")], "id string, org string, uid string")
    store.snapshot(spark.createDataFrame([("t", "z", "{}", "r")], DOC), 0, {"members": rows})
    both = ["org", "uid"]
    changes = [
        ("1", 1, 0, "update", None, ["uid"], None, "u9"),  # org is carried forward
        ("2", 1, 1, "delete", None, [], None, None),
        ("2", 2, 0, "insert", None, ["uid"], None, "u7"),  # begins anew
        ("5", 2, 1, "update", "3", both, "o5", "u5"),  # another id
        ("6", 3, 0, "insert", None, both, "o6", "u6"),
        ("6", 3, 1, "delete", None, [], None, None),
    ]
    none = spark.createDataFrame([], CHANGE)
    m = store.apply(none, {"members": spark.createDataFrame(changes, LOOKUP_CHANGE)})
    want = {("1", "o1", "u9"), ("2", None, "u7"), ("5", "o5", "u5"), ("4", "o4", "u4")}
    assert as_set(store.lookup("members").select("id", "org", "uid")) == want and m.last_lsn == 3 and m.last_op_id == store.manifest().snapshot_floor
    assert store.apply(none, {"members": spark.createDataFrame(changes, LOOKUP_CHANGE)}) == m  # delivered again
    m = store.apply(spark.createDataFrame([change(4, "insert", "a", "{}", "r")], CHANGE))
    assert as_set(store.lookup("members").select("id", "org", "uid")) == want and set(store.lookups()) == {"members"}
    assert store.clear().generation > m.generation and set(store.lookups()) == {"members"}
    with pytest.raises(RuleError, match="no snapshot of other"):
        store.apply(none, {"other": spark.createDataFrame([("1", 9, 0, "delete", None, [], None, None)], LOOKUP_CHANGE)})
    assert spark.read.parquet(f"{store.uri}/raw/*/raw").count() == 1
