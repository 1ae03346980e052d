"""Requests over a store: which buckets, from where, in what encoding; and the routes around them.

A Service answers a request with a status, headers and an iterator of bytes, so that it can be tested without a
socket; serve() puts it behind the standard library's HTTP server. Lines are computed by Spark and fetched a partition
at a time, each page in a line of its own.
"""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import buckets, cdc, serve
from ..plans.explain import explain
from ..plans.model import Plan, RuleError
from ..streaming.runner import wait_for_change
from ..streaming.store import Store
from . import bson
from .auth import ApiTokens, AuthError, Token, Users, flatten
from .control import Conflict, Control, validate

NDJSON = "application/x-ndjson"
#: Names of the binary stream, with any vendor's prefix; a client gets the name it asked for.
BSON = re.compile(r"application/(?:vnd\.[\w-]+\.)?bson-stream")
JSON = "application/json; charset=utf-8"
MAX_BODY, READERS, READER_WAIT, MAX_SECONDS = 256 * 1024, 8, 2.0, 300.0


@dataclass(frozen=True)
class Budget:
    """What one response may hold: entries, and bytes of their documents and keys."""

    entries: int = 250_000
    chars: int = 128 << 20


@dataclass
class Response:
    status: int
    headers: dict[str, str]
    body: Iterator[bytes]


def reply(status: int, payload, **headers: str) -> Response:
    return Response(status, {"Content-Type": JSON} | {k.replace("_", "-"): v for k, v in headers.items()}, iter([json.dumps(payload, ensure_ascii=False).encode()]))


class Bad(Exception):
    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


def header(headers: Mapping[str, str], name: str) -> str | None:
    return next((v for k, v in headers.items() if k.lower() == name), None)


def encoding(headers: Mapping[str, str], binary: bool) -> str:
    """The media type of a response."""
    accept = header(headers, "accept")
    if accept is None:
        return "application/bson-stream" if binary else NDJSON
    if found := BSON.search(accept):
        return found[0]
    if NDJSON in accept or "*/*" in accept:
        return NDJSON
    raise Bad(406, f"responses are {NDJSON} or application/bson-stream")


def body_of(body: bytes) -> dict:
    if len(body) > MAX_BODY:
        raise Bad(413, "the request is too large")
    try:
        out = json.loads(body or b"{}")
    except ValueError:
        raise Bad(400, "invalid request JSON") from None
    if not isinstance(out, dict):
        raise Bad(422, "the request is not an object")
    return out


def shaped(request: Mapping, name: str, kind: type, default):
    """A member of the request, which must be of its kind if it is there."""
    got = request.get(name)
    if got is None:
        return default
    if not isinstance(got, kind):
        raise Bad(422, f"{name} is not of the right kind")
    return got


class Service:
    """`tables` has the rows of lookup tables that the store does not keep. Without users nobody is let in, unless `anonymous` says that everybody
    may read every bucket."""

    def __init__(self, store: Store, control: Control, users: Users | None = None, api: ApiTokens | None = None, tables: Mapping[str, DataFrame] | None = None, anonymous: bool = False):
        if anonymous and users:
            raise ValueError("either users have tokens or everybody may read")
        self.store, self.control, self.api, self.anonymous = store, control, api or ApiTokens(), anonymous
        self.users = users or Users()
        self.tables, self.budget = tables or {}, Budget()
        self.ready = lambda: store.open() is not None
        self.readers = threading.BoundedSemaphore(READERS)
        self.served = {"requests": 0, "lines": 0, "refused": 0}

    # -- which buckets -------------------------------------------------------------------------------------------------

    def cursors(self, plan: Plan, request: Mapping, token: Token | None) -> dict[str, int]:
        """Bucket to the operation that the client has seen last (0: none)."""
        seen: dict[str, int] = {}
        for b in shaped(request, "buckets", list, []):
            if not isinstance(b, dict) or not isinstance(b.get("name"), str) or not re.fullmatch(r"\d{1,19}", str(b.get("after"))):
                raise Bad(400, f"invalid cursor {json.dumps(b)[:200]}")
            seen[b["name"]] = int(b["after"])
        asked = flatten(shaped(request, "parameters", dict, {}))
        context = token.request(asked) if token else {"parameters": asked}
        defaults = buckets.default_buckets(plan, context)
        tables = {**self.tables, **self.store.lookups()} if plan.lookups() else {}
        streams, only = shaped(request, "streams", dict, None), shaped(request, "only", list, [])
        if streams is not None:
            wanted = list(defaults) if streams.get("include_defaults") in (None, True) else []
            for s in shaped(streams, "subscriptions", list, []):
                if not isinstance(s, dict) or not isinstance(s.get("stream"), str):
                    raise Bad(422, "a subscription names a stream")
                wanted += buckets.resolve(plan, s["stream"], context | {"subscription": flatten(shaped(s, "parameters", dict, {}))}, tables)
        else:
            wanted = only or list(seen) or defaults
            for name in only or seen:
                self.allow(plan, name, defaults, token)
        wanted = list(dict.fromkeys(wanted))
        if len(wanted) > buckets.MAX_BUCKETS:
            raise Bad(400, f"a request has at most {buckets.MAX_BUCKETS} buckets")
        return {name: seen.get(name, 0) for name in wanted}

    def allow(self, plan: Plan, name, defaults: list[str], token: Token | None) -> None:
        """A bucket that is named outright must be a default of the request; if everybody may read, it must exist."""
        if not isinstance(name, str):
            raise Bad(422, "a bucket is named by a text")
        if token is None:
            stream, group, values = buckets.parse_bucket(name)
            groups = plan.stream(stream).groups()
            if group >= len(groups) or len(groups[group][0].parameters) != len(values):
                raise RuleError(f"unknown bucket {name}")
        elif name not in defaults:
            raise RuleError(f"bucket {name} is not a default: subscribe to its stream")

    # -- lines ---------------------------------------------------------------------------------------------------------

    def lines(self, cursors: Mapping[str, int]) -> tuple[Iterator[str], int]:
        """The response from one manifest, and the operation at which every bucket then stands. Only the parts of the
        store that can hold the buckets are read; their sums are those that the store keeps."""
        m, spark = self.store.manifest(), self.store.spark
        names = list(cursors)
        own = F.col("bucket").isin(names)
        rows = self.store.current(names, m).withColumn("bucket", F.col("route")).filter(own)
        sums = self.store.sums(names, m).filter(own)
        found = cdc.effects(self.store.table("tail", m), lambda route: route).filter(own)
        gone = self.store.table("superseded", m).filter(own)
        old = cdc.superseded_checkpoint(found).unionByName(gone).groupBy("bucket").agg(F.sum("count").alias("count"), cdc.checksum_sum().alias("checksum"))
        asked = serve.decide(spark.createDataFrame(list(cursors.items()), "bucket string, after long"), m.last_op_id, m.snapshot_floor, m.retained_floor)
        asked = self.within_budget(asked, found, sums)
        entries = serve.snapshot_entries(rows, asked, m.last_op_id, old).unionByName(serve.delta_entries(found, asked))
        out = serve.lines(cdc.checkpoint(sums.select("bucket", "count", "checksum"), old), entries, asked, m.last_op_id)
        return (r["json"] for r in out.select("line_no", "json").orderBy("line_no").toLocalIterator()), m.last_op_id

    def within_budget(self, asked: DataFrame, found: DataFrame, sums: DataFrame) -> DataFrame:
        """Deltas of more entries or bytes than a request may have become resets; a request whose documents are too
        many is refused."""
        size = F.coalesce(F.octet_length("data"), F.lit(0)) + F.octet_length("object_type") + F.octet_length("object_id")
        deltas = found.join(F.broadcast(asked.filter("mode = 'delta'")), "bucket").filter(F.col("op_id") > F.col("after"))
        per = {r["bucket"]: (r["n"], r["bytes"]) for r in deltas.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).collect()}  # a row a bucket asked for
        entries = chars = 0
        reset = []
        for bucket, (n, of) in sorted(per.items()):
            if entries + n > self.budget.entries or chars + of > self.budget.chars:
                reset.append(bucket)
            else:
                entries, chars = entries + n, chars + of
        if reset:
            asked = asked.withColumn("mode", F.when(F.col("bucket").isin(reset), F.lit("reset")).otherwise(F.col("mode")))
        whole = sums.join(F.broadcast(asked.filter("mode != 'delta'").select("bucket")), "bucket").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        if whole["n"] + entries > self.budget.entries or whole["bytes"] + chars > self.budget.chars:
            raise Bad(413, "the buckets hold more than one response may")
        return asked

    def stream(self, cursors: dict[str, int], kind: str, seconds: float) -> Iterator[bytes]:
        """Lines of the present state and then, for up to `seconds`, of every later one."""
        end = time.monotonic() + seconds
        while True:
            lines, last = self.lines(cursors)
            for line in lines:
                self.served["lines"] += 1
                yield line.encode() + b"\n" if kind == NDJSON else bson.encode(json.loads(line))
            cursors = dict.fromkeys(cursors, last)
            left = end - time.monotonic()
            if left <= 0 or not wait_for_change(self.store, last, left):
                return

    def sync(self, headers: Mapping[str, str], body: bytes) -> Response:
        if not self.ready():
            return reply(503, {"error": "the store is not ready"})
        token = None if self.anonymous else self.users.authorize(headers)
        request = body_of(body)
        kind = encoding(headers, bool(request.get("binary_data")))
        cursors = self.cursors(self.control.plan(), request, token)
        held = bool(request.get("raw_data")) and not str(request.get("client_id", "")).startswith("probe-")
        seconds = min(MAX_SECONDS, token.seconds_left() if token else MAX_SECONDS) if held else 0.0
        if not self.readers.acquire(timeout=READER_WAIT):
            return reply(503, {"error": "too many requests are being read"}, Retry_After="1")

        def run() -> Iterator[bytes]:
            try:
                yield from self.stream(cursors, kind, seconds)
            finally:
                self.readers.release()

        started = run()
        try:
            first = next(started)  # from here on the iterator's end gives the place back, however it ends
        except Bad:
            raise
        except Exception as error:
            raise Bad(500, f"the buckets cannot be read: {type(error).__name__}") from error
        return Response(200, {"Content-Type": kind, "Cache-Control": "no-store", "X-Accel-Buffering": "no"}, Body(first, started))

    # -- other routes --------------------------------------------------------------------------------------------------

    def rules_text(self, headers: Mapping[str, str], body: bytes) -> tuple[str, dict]:
        """Rules sent as they are, or in a JSON object with content, base_version and intent_token."""
        if "json" not in (header(headers, "content-type") or ""):
            try:
                return body.decode(), {}
            except ValueError:
                raise Bad(400, "rules are UTF-8 text") from None
        given = body_of(body)
        return shaped(given, "content", str, ""), options(given)

    def manage(self, path: str, headers: Mapping[str, str], body: bytes) -> Response:
        self.api.authorize(headers)
        if len(body) > MAX_BODY:
            raise Bad(413, "the request is too large")
        match path:
            case "/api/sync-rules/v1/current":
                return reply(200, self.control.describe())
            case "/api/sync-rules/v1/validate":
                return reply(200, validate(self.rules_text(headers, body)[0]))
            case "/api/sync-rules/v1/deploy":
                content, wish = self.rules_text(headers, body)
                return reply(200, self.control.deploy(content, **wish))
            case "/api/sync-rules/v1/reprocess" | "/api/admin/v1/reprocess":
                return reply(200, self.control.reprocess(**options(body_of(body))))
            case "/api/admin/v1/diagnostics":
                m = self.store.manifest()
                shown = {"generation": m.generation, "last_op_id": m.last_op_id, "last_lsn": m.last_lsn, "complete": m.complete} if m else None
                return reply(200, {"ready": self.ready(), "store": shown, "plan": explain(self.control.plan()), "rules": self.control.describe(bool(body_of(body).get("sync_rules_content")))})
            case "/api/admin/v1/schema":
                plan = self.control.plan()
                return reply(200, {"tables": [{"name": t, "lookup": t not in plan.sources()} for t in dict.fromkeys([*plan.sources(), *(x.table for x in plan.lookups())])]})
            case "/api/admin/v1/validate":
                found = validate(self.rules_text(headers, body)[0])
                return reply(200, {"connections": [], "tables": found["source_tables"], "errors": [{"level": "fatal", "message": e} for e in found["errors"]]})
        return reply(501, {"error": "SQL is not run for clients"})  # /api/admin/v1/execute-sql

    ROUTES = {
        **{p: "GET" for p in ("/healthz", "/debug/metrics", "/probes/liveness", "/probes/readiness", "/api/sync-rules/v1/current")},
        **{p: "POST" for p in ("/sync/stream", *(f"/api/sync-rules/v1/{x}" for x in ("validate", "deploy", "reprocess")), *(f"/api/admin/v1/{x}" for x in ("diagnostics", "schema", "validate", "reprocess", "execute-sql")))},
    }

    def respond(self, method: str, path: str, headers: Mapping[str, str], body: bytes = b"") -> Response:
        path = path.split("?")[0]
        self.served["requests"] += 1
        if path not in self.ROUTES:
            return reply(404, {"error": "no such path"})
        if method == "OPTIONS" and path == "/sync/stream":
            return Response(204, {"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "POST", "Access-Control-Allow-Headers": "authorization, content-type, accept"}, iter(()))
        if method != self.ROUTES[path]:
            return reply(405, {"error": "this path has another method"}, Allow=self.ROUTES[path])
        try:
            match path:
                case "/sync/stream":
                    return self.sync(headers, body)
                case "/healthz" | "/probes/liveness":
                    return reply(200, {"ok": True})
                case "/probes/readiness":
                    ready = self.ready()
                    return reply(200 if ready else 503, {"ready": ready})
                case "/debug/metrics":
                    if self.api.tokens:
                        self.api.authorize(headers)
                    return reply(200, self.served | self.store.counters)
            return self.manage(path, headers, body)
        except AuthError as error:
            self.served["refused"] += 1
            return reply(401, error.body())
        except Bad as error:
            return reply(error.status, {"error": str(error)})
        except Conflict as error:
            return reply(error.status, {"error": str(error)})
        except RuleError as error:
            return reply(400, {"error": str(error)})


def options(given: Mapping) -> dict:
    return {"base_version": shaped(given, "base_version", int, None), "token": shaped(given, "intent_token", str, None)}


class Body:
    """An iterator whose first element is known; closing it closes the rest."""

    def __init__(self, first: bytes, rest):
        self.first, self.rest = first, rest

    def __iter__(self) -> Iterator[bytes]:
        yield self.first
        yield from self.rest

    def close(self) -> None:
        self.rest.close()


def serve_http(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is bound; call serve_forever() on it. Bodies are sent in chunks as they are made."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def handle_one(self) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
            except ValueError:
                size = -1
            if not 0 <= size <= MAX_BODY:
                self.close_connection = True
                answer = reply(413 if size > 0 else 400, {"error": "the request's length is not accepted"})
            else:
                answer = service.respond(self.command, self.path, dict(self.headers.items()), self.rfile.read(size))
            try:
                self.send_response(answer.status)
                for k, v in answer.headers.items():
                    self.send_header(k, v)
                if answer.status != 204:
                    self.send_header("Transfer-Encoding", "chunked")
                self.end_headers()
                for part in answer.body:
                    if part:
                        self.wfile.write(b"%x\r\n%s\r\n" % (len(part), part))
                if answer.status != 204:
                    self.wfile.write(b"0\r\n\r\n")
            except (BrokenPipeError, ConnectionResetError):
                self.close_connection = True
            except Exception:
                self.close_connection = True  # no end mark: the client sees that the answer is not whole
                raise
            finally:
                if hasattr(answer.body, "close"):
                    answer.body.close()

        do_GET = do_POST = do_OPTIONS = do_PUT = do_DELETE = handle_one

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
