"""Tokens, rules' life, encodings, the replication log's messages, and what a client adds up from responses."""

import base64
import hashlib
import hmac
import http.client
import http.server
import json
import struct
import threading

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributary.plans.model import RuleError
from tributary.serving import bson
from tributary.serving.auth import SHA256_DER, ApiTokens, AuthError, PublicKey, Secret, Users, fetch_keys, flatten, parse_keys
from tributary.serving.control import HISTORY, Conflict, Control, validate
from tributary.serving.service import Budget, Service, serve_http
from tributary.sources import wal
from tributary.streaming import runner
from tributary.streaming.store import Store

DOC = "object_type string, object_id string, data string, route string"
CHANGE = "lsn long, seq int, kind string, object_type string, object_id string, data string, route string, old_id string, old_route string"
RULES = "streams:\n  all:\n    auto_subscribe: true\n    query: SELECT * FROM t\n  own:\n    query: SELECT * FROM t WHERE owner = auth.user_id()\n"
NOW = 1_000_000
VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 63) - 1) | st.floats(allow_nan=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text().filter(lambda k: "\0" not in k), x), max_leaves=8)


@given(st.dictionaries(st.text().filter(lambda k: "\0" not in k), VALUES))
def test_bson_round_trip(doc):
    assert bson.decode(bson.encode(doc)) == doc


def test_bson_known_bytes():
    assert bson.encode({"hello": "world"}) == b"\x16\0\0\0\x02hello\0\x06\0\0\0world\0\0"
    for bad in (b"", b"\x05\0\0\0\1", b"\x06\0\0\0\0"):
        with pytest.raises(ValueError):
            bson.decode(bad)


def part(x) -> str:
    raw = x if isinstance(x, bytes) else json.dumps(x).encode()
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def hs256(claims, secret=b"s", **header) -> str:
    signed = f"{part({'alg': 'HS256'} | header)}.{part(claims)}"
    return f"{signed}.{part(hmac.digest(secret, signed.encode(), 'sha256'))}"


def users(*keys, **policy) -> Users:
    return Users(keys or (Secret(b"s"),), clock=lambda: NOW, **policy)


def test_token_claims():
    token = users().verify(hs256({"exp": NOW + 9.5, "sub": "u", "a": {"b": 1, "c": None, "d": [1, "x"]}}))
    assert (token.user_id, token.exp) == ("u", NOW + 9) and token.request({"p": "1"})["claims"] == {"exp": str(NOW + 9.5), "sub": "u", "a.b": "1", "a.d": '[1,"x"]'}
    assert users().verify(hs256({"exp": NOW + 9, "user_id": "v"})).user_id == "v" and flatten({"t": True}) == {"t": "true"}
    fine = {"exp": NOW + 9}
    for claims in ({}, {"exp": NOW}, {"exp": "x"}, {"exp": True}, fine | {"nbf": NOW + 61}, fine | {"nbf": None}):
        with pytest.raises(AuthError):
            users().verify(hs256(claims))
    assert users().verify(hs256(fine | {"nbf": NOW + 60}))


def test_token_policy_and_keys():
    fine = {"exp": NOW + 9}
    strict = users(Secret(b"s", "k"), Secret(b"t", "l"), audiences=["a"], issuers=["i"])
    assert strict.verify(hs256(fine | {"aud": ["z", "a"], "iss": "i"}, kid="k"))
    for token in (hs256(fine | {"aud": "z", "iss": "i"}, kid="k"), hs256(fine | {"aud": "a"}, kid="k"), hs256(fine | {"aud": "a", "iss": "i"}), hs256(fine | {"aud": "a", "iss": "i"}, kid="l"), hs256(fine | {"aud": "a", "iss": "i"}, kid="x")):
        with pytest.raises(AuthError):
            strict.verify(token)
    whole = hs256(fine)
    for token in (whole[:-2] + "AA", whole + ".x", "a.b", "", whole.replace(".", "=.", 1), f"{part({'alg': 'none'})}.{part(fine)}."):
        with pytest.raises(AuthError):
            users().verify(token)
    assert users().authorize({"authorization": f"bearer {whole}"}) and users().authorize({"Authorization": f"Token {whole}"})
    for value in ("", whole, f"Basic {whole}", f"Bearer {whole} x"):
        with pytest.raises(AuthError):
            users().authorize({"Authorization": value})


def test_rsa():
    p, q, e = (1 << 521) - 1, (1 << 607) - 1, 65537
    n, size = p * q, 141
    signed = f"{part({'alg': 'RS256'})}.{part({'exp': NOW + 1})}"

    def sign(digest_prefix):
        tail = b"\0" + digest_prefix + hashlib.sha256(signed.encode()).digest()
        message = b"\0\1" + b"\xff" * (size - len(tail) - 2) + tail
        return pow(int.from_bytes(message), pow(e, -1, (p - 1) * (q - 1)), n).to_bytes(size)

    good = sign(SHA256_DER)
    assert users(PublicKey(n, e)).verify(f"{signed}.{part(good)}")
    for bad in (good[:-1], good[:-1] + bytes([good[-1] ^ 1]), sign(SHA256_DER[:-1] + b"\x21"), n.to_bytes(size)):
        with pytest.raises(AuthError):
            users(PublicKey(n, e)).verify(f"{signed}.{part(bad)}")
    with pytest.raises(AuthError):  # a public key is no shared secret
        users(PublicKey(n, e)).verify(hs256({"exp": NOW + 1}, str(n).encode()))


def test_api_tokens():
    ApiTokens(["a", "b"]).authorize({"Authorization": "Bearer b"})
    for own, given_ in ((["a"], "Bearer c"), ([], "Bearer a"), (["a"], "")):
        with pytest.raises(AuthError):
            ApiTokens(own).authorize({"Authorization": given_})


def test_control():
    kept = {}
    control = Control(RULES, lambda: kept.get("s"), lambda text: kept.update(s=text), clock=lambda: 1.0)
    same = RULES + "\n# a note\n"
    assert control.deploy(same) == {"operation": "deploy", "version": 2, "base_version": 1, "status": "active", "changed": True}
    assert control.deploy(same, base_version=1)["changed"] is False  # the same wish again
    with pytest.raises(Conflict, match="stale"):
        control.deploy(RULES, base_version=1)
    with pytest.raises(Conflict, match="layout"):
        control.deploy(RULES.replace("FROM t\n", "FROM u\n", 1))
    assert control.current.version == 2 and control.next is None and [e.status for e in control.history] == ["retired", "active", "failed"]
    with pytest.raises(RuleError):
        control.deploy("streams: 1")
    entry, met = control.stage(RULES)
    assert not met and control.stage(RULES) == (entry, False)
    with pytest.raises(Conflict, match="pending"):
        control.stage(same, "reprocess")
    kept["s"] = kept["s"].replace('"pending"', '"activating"')  # ended half-way
    again = Control("", lambda: kept["s"], lambda text: kept.update(s=text))
    assert again.next.status == "pending" and again.activate().version == entry.version
    with pytest.raises(Conflict, match="no candidate"):
        again.activate()
    with pytest.raises(Conflict, match="not reprocessed"):
        again.reprocess()
    assert again.next is None and again.history[-1].version == entry.version
    for i in range(HISTORY + 5):
        again.deploy(RULES + f"# {i}")
    assert len(again.history) == HISTORY and again.plan().streams[0].name == "all"
    assert validate(RULES)["source_tables"] == ["t"] and not validate("x: [")["valid"]


# -- the replication log -----------------------------------------------------------------------------------------------


def relation(ident=7, columns=(("id", 25, 1), ("v", 23, 0))):
    return b"R" + struct.pack(">I", ident) + b"public\0t\0d" + struct.pack(">h", len(columns)) + b"".join(bytes([k]) + n.encode() + b"\0" + struct.pack(">Ii", oid, -1) for n, oid, k in columns)


def values(*vs):
    return struct.pack(">h", len(vs)) + b"".join(b"n" if v is None else b"u" if v is ... else b"t" + struct.pack(">i", len(v.encode())) + v.encode() for v in vs)


def begin(xid):
    return b"B" + struct.pack(">qqI", 1, 5, xid)


def commit(end):
    return b"C\0" + struct.pack(">qqq", end - 1, end, 5)


ID = struct.pack(">I", 7)


def test_wal(spark):
    log = [relation(), begin(3), b"I" + ID + b"N" + values("é", None), b"U" + ID + b"N" + values("a", ...), b"U" + ID + b"O" + values("a", "1") + b"N" + values("b", "2"), b"Y", commit(90), begin(4), commit(95), begin(5), b"D" + ID + b"K" + values("b", None), b"T" + struct.pack(">IB", 1, 0) + ID, commit(99), begin(6), b"I" + ID + b"N" + values("x", "y")]
    first, second = wal.transactions(log)
    assert [(r["kind"], r["present"], r["row"], r["old"]) for r in first] == [("insert", ["id", "v"], {"id": "é", "v": None}, None), ("update", ["id"], {"id": "a"}, None), ("update", ["id", "v"], {"id": "b", "v": "2"}, {"id": "a", "v": "1"})]
    assert [(r["xid"], r["lsn"], r["seq"], r["kind"], r["old"]) for r in second] == [(5, 99, 0, "delete", {"id": "b", "v": None}), (5, 99, 1, "truncate", None)]
    assert spark.createDataFrame(first + second, wal.SCHEMA).filter("row['v'] = '2'").count() == 1


@pytest.mark.parametrize("log", [[commit(1)], [begin(1), begin(2)], [relation(), b"I" + ID + b"N" + values("a", "b")], [begin(1), b"I" + ID + b"N" + values("a")], [relation(), begin(1), b"I" + ID + b"N" + values("a")], [relation(), begin(1), b"I" + ID + b"N" + values("a", "b")[:-1]], [b"Z"], [b""]])
def test_wal_refuses(log):
    with pytest.raises(RuleError):
        list(wal.transactions(log))


def test_message_files_reach_the_store(spark, tmp_path):
    """Captured messages, as files that arrive, decoded by tasks and folded into a store."""
    source, store = tmp_path / "wal", Store(spark, f"file://{tmp_path}/s", "c")
    source.mkdir()
    store.snapshot(spark.createDataFrame([("t", "old", "{}", ALL)], DOC), 0)

    def to_changes(df):
        none = F.lit(None).cast("string")
        data = F.when(F.col("kind") != "delete", F.to_json("row"))
        return df.select("lsn", "seq", "kind", F.col("table").alias("object_type"), F.coalesce(F.col("row")["id"], F.col("old")["id"]).alias("object_id"), data.alias("data"), F.lit(ALL).alias("route"), none.alias("old_id"), none.alias("old_route"))

    files = [
        [relation(), begin(1), b"I" + ID + b"N" + values("a", "1"), b"I" + ID + b"N" + values("b", "1"), commit(10)],
        [relation(), begin(2), b"U" + ID + b"N" + values("a", "2"), commit(20), begin(3), b"D" + ID + b"K" + values("b", None), commit(30)],
    ]
    for i, messages in enumerate(files):
        (source / f"{i}.wal").write_bytes(wal.framed(messages))
        stream = wal.message_stream(spark, str(source))
        runner.start(stream, store, str(tmp_path / "cp"), to_changes).awaitTermination()
    assert {(r.object_id, r.data) for r in store.table("current").collect()} == {("old", "{}"), ("a", '{"id":"a","v":"2"}')}
    assert store.manifest().last_lsn == 30 and store.counters["operations"] == 4
    seen = []
    runner.tap(wal.message_stream(spark, str(source)), lambda df: seen.append(df.count()), str(tmp_path / "tap")).awaitTermination()
    assert sum(seen) == 4 and store.manifest().last_lsn == 30
    with pytest.raises(RuleError):
        list(wal.unframed(wal.framed(files[0])[:-1]))


def test_key_sets(tmp_path):
    keys = {"keys": [{"kty": "oct", "k": part(b"s"), "kid": "a"}, {"kty": "RSA", "n": part(b"\x01\x00\x01"), "e": part(b"\x03")}, {"kty": "EC"}, {"kty": "oct", "k": "x", "use": "enc"}]}
    assert parse_keys(json.dumps(keys)) == [Secret(b"s", "a"), PublicKey(65537, 3)]
    for bad in ("", "[]", "{}", '{"keys":[]}', '{"keys":[{"kty":"EC"}]}', '{"keys":[{"kty":"oct"}]}', '{"keys":["x"]}'):
        with pytest.raises(ValueError):
            parse_keys(bad)
    for url in ("http://example.org/keys", "ftp://localhost/keys", "file:///etc/passwd", "keys", "http://localhost.example.org/"):
        with pytest.raises(ValueError, match="https"):
            fetch_keys(url)

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(302 if self.path == "/away" else 200)
            if self.path == "/away":
                self.send_header("Location", "/keys")
            self.end_headers()
            self.wfile.write(json.dumps(keys).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_address[1]}"
        assert users(*fetch_keys(f"{at}/keys")).verify(hs256({"exp": NOW + 9}, kid="a"))
        for url in (f"{at}/away", "http://127.0.0.1:9/keys"):
            with pytest.raises(ValueError, match="cannot be fetched"):
                fetch_keys(url)
        with pytest.raises(ValueError, match="too large"):
            fetch_keys(f"{at}/keys", most=10)
    finally:
        server.shutdown()
        server.server_close()


def test_lookups_of_the_store_bind_subscriptions(spark, tmp_path):
    rules = "streams:\n  orgs:\n    with:\n      m: SELECT org FROM members WHERE uid = auth.user_id()\n    query: SELECT * FROM t, m AS b WHERE t.org = b.org\n"
    store = Store(spark, f"file://{tmp_path}/s", "c")
    docs = [("t", "a", "{}", '1#orgs|0["o1"]'), ("t", "b", "{}", '1#orgs|0["o2"]')]
    store.snapshot(spark.createDataFrame(docs, DOC), 0, {"members": spark.createDataFrame([("1", "o1", "u1"), ("2", "o2", "u2")], "id string, org string, uid string")})
    service = Service(store, Control(rules), users())
    signed = {"Authorization": f"Bearer {hs256({'exp': NOW + 9, 'sub': 'u1'})}"}
    client = Client()
    client.read(service.respond("POST", "/sync/stream", signed, json.dumps({"streams": {"subscriptions": [{"stream": "orgs"}]}}).encode()))
    assert set(client.docs) == {('1#orgs|0["o1"]', "a")}


# -- responses ---------------------------------------------------------------------------------------------------------

ALL, U1 = "1#all|0[]", '1#own|0["u1"]'


def changed(spark, lsn, kind, ident, data=None, route=None):
    return spark.createDataFrame([(lsn, 0, kind, "t", ident, data, route, None, None)], CHANGE)


class Client:
    """Adds up checksums as they are received."""

    def __init__(self):
        self.after, self.sums, self.docs = {}, {}, {}

    def read(self, response):
        assert response.status == 200
        lines = [json.loads(x) for x in b"".join(response.body).splitlines()]
        kinds = [next(iter(x)) for x in lines]
        assert kinds[0] == "checkpoint" and kinds[-1] == "checkpoint_complete" and set(kinds[1:-1]) <= {"data"}
        for line in lines[1:-1]:
            bucket = line["data"]["bucket"]
            for entry in line["data"]["data"]:
                key = (bucket, entry.get("object_id"))
                if entry["op"] == "CLEAR":
                    self.sums[bucket], self.docs = 0, {k: v for k, v in self.docs.items() if k[0] != bucket}
                elif entry["op"] == "PUT":
                    self.docs[key] = entry["data"]
                else:
                    self.docs.pop(key, None)
                self.sums[bucket] = (self.sums.get(bucket, 0) + entry["checksum"]) % (1 << 32)
        for b in lines[0]["checkpoint"]["buckets"]:
            assert b["checksum"] % (1 << 32) == self.sums.get(b["bucket"], 0), (b, self.sums)
            self.after[b["bucket"]] = lines[-1]["checkpoint_complete"]["last_op_id"]
        return lines

    def request(self, **more):
        return json.dumps({"buckets": [{"name": k, "after": v} for k, v in self.after.items()], "streams": {"subscriptions": [{"stream": "own"}]}} | more).encode()


def test_clients_sums_agree(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "c", keep=3)
    service = Service(store, Control(RULES), users())
    signed = {"Authorization": f"Bearer {hs256({'exp': NOW + 9, 'sub': 'u1'})}"}
    assert service.respond("POST", "/sync/stream", signed).status == 503 and service.respond("GET", "/probes/readiness", {}).status == 503
    store.snapshot(spark.createDataFrame([("t", f"k{i}", f'{{"i":{i}}}', (ALL, U1)[i % 2]) for i in range(6)], DOC), 0)
    early, ask = Client(), lambda c: c.read(service.respond("POST", "/sync/stream", signed, c.request()))
    ask(early)
    assert set(early.docs) == {(ALL if i % 2 == 0 else U1, f"k{i}") for i in range(6)}
    for lsn, (kind, ident, data, route) in enumerate([("insert", "k0", '{"n":1}', U1), ("delete", "k1", None, None)], 1):
        store.apply(changed(spark, lsn, kind, ident, data, route))
    ask(early)  # a delta: k0 moves
    fresh = Client()
    ask(fresh)  # CLEAR brings the checksum of what is superseded
    assert early.docs == fresh.docs and (U1, "k0") in fresh.docs and (ALL, "k0") not in fresh.docs
    for lsn in range(3, 7):  # the log keeps three operations
        store.apply(changed(spark, lsn, "insert", "k2", f'{{"n":{lsn}}}', ALL))
        ask(early)
    late = Client()
    ask(late)
    ask(fresh)  # below the retained floor: a reset
    assert early.docs == late.docs == fresh.docs and len(store.table("superseded").collect()) > 0
    store.apply(changed(spark, 8, "insert", "k3", '{"n":8}', ALL))
    service.budget = Budget(entries=len(early.docs) + 1, chars=1 << 20)
    store.apply(changed(spark, 9, "insert", "k4", '{"n":9}', ALL))
    tight = Service(store, Control(RULES), users())
    tight.budget = Budget(chars=200)
    after = dict(early.after)
    lines = early.read(tight.respond("POST", "/sync/stream", signed, early.request()))  # a delta within the budget
    assert early.after != after and len(lines) > 2


def test_requests(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "c")
    store.snapshot(spark.createDataFrame([("t", "a", "{}", ALL)], DOC), 0)
    service = Service(store, Control(RULES), users(), ApiTokens(["op"]))
    signed = {"authorization": f"Bearer {hs256({'exp': NOW + 9, 'sub': 'u1'})}"}

    def status(body, headers=signed, path="/sync/stream", method="POST"):
        return service.respond(method, path, headers, body if isinstance(body, bytes) else json.dumps(body).encode()).status

    assert status({}, {}) == 401 and status(b"{") == 400 and status([1]) == 422 and status({"buckets": 3}) == 422
    assert status({"buckets": [{"name": ALL, "after": "-1"}]}) == 400 and status({"only": [U1]}) == 400  # not a default
    assert status({"streams": {"subscriptions": [{"stream": "none"}]}}) == 400
    assert status({}, signed | {"Accept": "text/html"}) == 406 and status({}, signed, "/x") == 404 and status({}, signed, "/healthz") == 405
    assert status(b"", {}, "/sync/stream", "OPTIONS") == 204 and status(b" " * 300_000) == 413
    answer = service.respond("POST", "/sync/stream", signed | {"Accept": "application/vnd.some.bson-stream"}, b"{}")
    data, docs = b"".join(answer.body), []
    while data:
        n = struct.unpack_from("<i", data)[0]
        docs.append(bson.decode(data[:n]))
        data = data[n:]
    assert answer.headers["Content-Type"] == "application/vnd.some.bson-stream" and [next(iter(d)) for d in docs] == ["checkpoint", "data", "checkpoint_complete"]
    manage = {"Authorization": "Bearer op", "Content-Type": "application/json"}
    assert status({}, {}, "/api/admin/v1/schema") == 401 and status({}, manage, "/api/admin/v1/execute-sql") == 501
    assert status({"content": RULES}, manage, "/api/sync-rules/v1/deploy") == 200 and status({"content": RULES + " ", "base_version": 9}, manage, "/api/sync-rules/v1/deploy") == 409
    assert status({"content": "x"}, manage, "/api/sync-rules/v1/deploy") == 400 and status({"content": "x"}, manage, "/api/sync-rules/v1/validate") == 200
    for path in ("diagnostics", "schema"):
        assert status({}, manage, f"/api/admin/v1/{path}") == 200
    was = service.control.describe()
    for path in ("/api/sync-rules/v1/reprocess", "/api/admin/v1/reprocess"):
        assert status({"base_version": 0, "intent_token": "again"}, manage, path) == 409
    assert service.control.describe() == was
    assert answer.headers["Cache-Control"] == "no-store" and answer.headers["X-Accel-Buffering"] == "no"
    for closed in (Service(store, Control(RULES)), Service(store, Control(RULES), Users())):  # nobody is let in by default
        for given_ in ({}, signed):
            assert closed.respond("POST", "/sync/stream", given_, b'{"buckets":[]}').status == 401
    assert status({}, {}, "/debug/metrics", "GET") == 401 and status({}, manage, "/debug/metrics", "GET") == 200
    assert Service(store, Control(RULES)).respond("GET", "/debug/metrics", {}).status == 200  # no token is configured
    small = Service(store, Control(RULES), users())
    small.budget = Budget(entries=0)
    assert small.respond("POST", "/sync/stream", signed, b"{}").status == 413
    with pytest.raises(ValueError):
        Service(store, Control(RULES), users(), anonymous=True)
    open_ = Service(store, Control(RULES), anonymous=True)  # existing buckets are for all
    assert open_.respond("POST", "/sync/stream", {}, json.dumps({"only": [U1]}).encode()).status == 200
    assert open_.respond("POST", "/sync/stream", {}, json.dumps({"only": ['1#own|0[]']}).encode()).status == 400


def test_held_open_and_socket(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "c")
    store.snapshot(spark.createDataFrame([("t", "a", "{}", ALL)], DOC), 0)
    service = Service(store, Control(RULES), anonymous=True)
    held = service.stream({ALL: 0}, "application/x-ndjson", 60)
    first = [json.loads(next(held)) for _ in range(3)]
    store.apply(changed(spark, 1, "insert", "b", '{"n":1}', ALL))
    later = [json.loads(next(held)) for _ in range(3)]
    held.close()
    assert [next(iter(x)) for x in first] == [next(iter(x)) for x in later] and [e["object_id"] for e in later[1]["data"]["data"]] == ["b"]
    server = serve_http(service)
    thread = threading.Thread(target=server.serve_forever)
    thread.start()
    try:
        link = http.client.HTTPConnection(*server.server_address, timeout=60)
        link.request("POST", "/sync/stream", "{}", {"Content-Type": "application/json"})
        got = link.getresponse()
        assert got.status == 200 and len(got.read().splitlines()) == 3
        link.request("GET", "/healthz")
        assert json.loads(link.getresponse().read()) == {"ok": True}
    finally:
        server.shutdown()
        thread.join()
        server.server_close()
    assert service.readers.acquire(blocking=False)
