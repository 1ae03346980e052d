"""The life of rules: one candidate at a time is staged, activated and kept in a history.

    pending -> activating -> active -> retired
                          -> failed

State is one JSON text, read and replaced whole by the functions given.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from ..plans.compiler import compile_rules
from ..plans.model import Plan, RuleError

HISTORY = 64
LAYOUT = "rules that change the layout of stored state need a new store"
REPROCESS = "rules are not reprocessed in place: stored state is rebuilt by a new snapshot"


class Conflict(Exception):
    """A change that the present state does not admit; status is 409."""

    status = 409


@dataclass(frozen=True)
class Entry:
    version: int
    content: str
    status: str
    operation: str = ""
    base_version: int | None = None
    intent: str | None = None
    contract: str = ""
    layout_change: bool = False
    reason: str | None = None
    created_ms: int = 0
    updated_ms: int = 0


def intent_of(operation: str, base: int, content: str, token: str | None) -> str:
    """One value for one wish, so that it can be repeated safely. Parts are JSON, which keeps them apart."""
    return hashlib.sha256(json.dumps([operation, base, token, content]).encode()).hexdigest()


class Control:
    def __init__(self, content: str, load: Callable[[], str | None] = lambda: None, save: Callable[[str], None] = lambda text: None, clock: Callable[[], float] = time.time):
        self._save, self._clock = save, clock
        stored = load()
        if stored:
            state = json.loads(stored)
            self.revision, self.history = state["revision"], [Entry(**e) for e in state["history"]]
        else:
            first = Entry(1, content, "active", "install", contract=compile_rules(content).contract_id, created_ms=self._now(), updated_ms=self._now())
            self.revision, self.history = 1, [first]
            self._persist()
        for e in self.history:
            if e.status == "activating":  # the process ended before it was decided
                self._set(e.version, status="pending")

    def _now(self) -> int:
        return int(self._clock() * 1000)

    def _persist(self) -> None:
        live = [e for e in self.history if e.status in ("active", "pending", "activating")]
        room = HISTORY - len(live)
        past = [e for e in self.history if e not in live][-room:]
        self.history = sorted(live + past, key=lambda e: e.version)
        self._save(json.dumps({"revision": self.revision, "history": [asdict(e) for e in self.history]}))

    def _set(self, version: int, **values) -> Entry:
        self.history = [replace(e, updated_ms=self._now(), **values) if e.version == version else e for e in self.history]
        self._persist()
        return next(e for e in self.history if e.version == version)

    @property
    def current(self) -> Entry:
        return next(e for e in self.history if e.status == "active")

    @property
    def next(self) -> Entry | None:
        return next((e for e in self.history if e.status in ("pending", "activating")), None)

    def plan(self) -> Plan:
        return compile_rules(self.current.content)

    def stage(self, content: str, operation: str = "deploy", base_version: int | None = None, token: str | None = None) -> tuple[Entry, bool]:
        """The candidate, and whether the wish was met before. Rules that do not compile are refused."""
        contract = compile_rules(content).contract_id
        current, waiting = self.current, self.next
        base = current.version if base_version is None else base_version
        intent = intent_of(operation, base, content, token)
        if waiting:
            if waiting.intent == intent:
                return waiting, False
            raise Conflict(f"version {waiting.version} is {waiting.status}: cannot {operation}")
        if current.intent == intent:
            return current, True
        if base != current.version:
            raise Conflict(f"base version {base} is stale: version {current.version} is active")
        self.revision += 1
        entry = Entry(self.revision, content, "pending", operation, base, intent, contract, contract != current.contract, None, self._now(), self._now())
        self.history = [*self.history, entry]
        self._persist()
        return entry, False

    def activate(self) -> Entry:
        """Make the candidate the active version; one that changes the layout fails and leaves all as it is."""
        waiting = self.next
        if waiting is None:
            raise Conflict("there is no candidate")
        self._set(waiting.version, status="activating")
        if waiting.layout_change:
            self._set(waiting.version, status="failed", reason=LAYOUT)
            raise Conflict(LAYOUT)
        # one replacement of the state, so that there is always one active version
        self.history = [replace(e, updated_ms=self._now(), status={"active": "retired", "activating": "active"}.get(e.status, e.status)) for e in self.history]
        self._persist()
        return self.current

    def deploy(self, content: str, base_version: int | None = None, token: str | None = None) -> dict:
        entry, met = self.stage(content, "deploy", base_version, token)
        return self.outcome("deploy", entry if met else self.activate(), not met)

    def reprocess(self, base_version: int | None = None, token: str | None = None) -> dict:
        """Refused, whatever is wished: stored state is rebuilt by a new snapshot only, and the active rules stay."""
        raise Conflict(REPROCESS)

    def outcome(self, operation: str, entry: Entry, changed: bool) -> dict:
        return {"operation": operation, "version": entry.version, "base_version": entry.base_version, "status": entry.status, "changed": changed}

    def describe(self, content: bool = True) -> dict:
        """The active and waiting versions, and the past."""

        def shown(e: Entry | None) -> dict | None:
            return e and {k: v for k, v in asdict(e).items() if content or k != "content"}

        return {"current": shown(self.current), "next": shown(self.next), "history": [{"version": e.version, "status": e.status, "reason": e.reason} for e in self.history]}


def validate(content: str) -> dict:
    """Whether rules compile, with what they define."""
    try:
        plan = compile_rules(content)
    except RuleError as error:
        return {"valid": False, "errors": [str(error)], "bucket_definitions": [], "source_tables": []}
    return {"valid": True, "errors": [], "bucket_definitions": plan.to_dict()["streams"], "source_tables": list(dict.fromkeys([*plan.sources(), *(x.table for x in plan.lookups())]))}
