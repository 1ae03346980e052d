"""Plans back as text: the SQL of every query, which compiles to the same plan, and the columns of what it gives."""

from __future__ import annotations

from collections.abc import Sequence

from .model import Binding, Column, Compare, IsNull, Literal, Logic, Lookup, Operand, Plan, Predicate, Query

#: How each kind of binding is written, by its name.
BINDINGS = {
    "auth": "auth.parameter({})",
    "user_id": "auth.user_id()",
    "claim": "request.jwt() ->> {}",
    "subscription": "subscription.parameter({})",
    "connection": "connection.parameter({})",
    "request": "request.parameters() ->> {}",
    "array": "request.parameter_array({})",
}


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def name(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def operand(x: Operand) -> str:
    match x:
        case Column():
            return name(x.name)
        case Literal(value=None):
            return "NULL"
        case Literal(value=bool(b)):
            return "TRUE" if b else "FALSE"
        case Literal():
            return quote(x.value) if isinstance(x.value, str) else str(x.value)
        case Binding():
            return BINDINGS[x.kind].format(quote(x.name))


def predicate(p: Predicate) -> str:
    match p:
        case Logic():
            return f" {p.op} ".join(f"({predicate(t)})" for t in p.terms)
        case IsNull():
            return f"{operand(p.operand)} IS {'NOT ' if p.negated else ''}NULL"
        case Compare():
            right = f"({', '.join(map(operand, p.right))})" if isinstance(p.right, tuple) else operand(p.right)
            return f"{operand(p.left)} {p.op} {right}"


def lookup_sql(x: Lookup) -> str:
    tests = [f"{name(c)} = {operand(b)}" for c, b in x.keys]
    for c, text, same in x.row_filter:
        tests.append(f"{name(c)} IS {'' if same else 'NOT '}NULL" if text is None else f"{name(c)} = {quote(text)}")
    return f"SELECT {name(x.selected)} FROM {name(x.table)} WHERE {' AND '.join(tests)}"


def query_sql(q: Query) -> tuple[str, dict[str, str]]:
    """The query and the common tables that it names."""
    outputs = [" || ".join(map(operand, o.parts)) + f" AS {name(o.alias)}" for o in q.projection.outputs]
    columns: Sequence[str] = ["*", *outputs] if q.projection.star else outputs
    with_, sources, tests = {}, [name(q.source)], []
    for i, p in enumerate(q.parameters):
        if p.binding.kind in ("lookup", "array"):
            table = f"p{i}"
            selected = q.lookup.selected if p.binding.kind == "lookup" else "value"
            with_[table] = lookup_sql(q.lookup) if p.binding.kind == "lookup" else f"SELECT value FROM json_each({operand(p.binding)})"
            sources.append(table)
            value, own = f"{table}.{name(selected)}", f"{name(q.source)}.{name(p.column)}"
        else:
            value, own = operand(p.binding), name(p.column)
        tests.append(f"{value} IN {own}" if p.array else f"{own} = {value}")
    tests += [f"({predicate(f)})" for f in (q.row_filter, q.request_filter) if f is not None]
    where = f" WHERE {' AND '.join(tests)}" if tests else ""
    return f"SELECT {', '.join(columns)} FROM {', '.join(sources)}{where}", with_


def explain(plan: Plan) -> dict:
    """Streams with their queries as SQL, and every output table with the columns that any query names."""
    streams, tables = [], {}
    for s in plan.streams:
        groups = []
        for g, queries in enumerate(s.groups()):
            groups.append({"bucket": f"1#{s.name}|{g}", "parameters": [p.column for p in queries[0].parameters], "queries": [dict(zip(("sql", "with"), query_sql(q), strict=True)) for q in queries]})
            for q in queries:
                known = tables.setdefault(q.output, {"source": q.source, "all_columns": False, "columns": []})
                known["all_columns"] |= q.projection.star
                known["columns"] = list(dict.fromkeys([*known["columns"], *(o.alias for o in q.projection.outputs)]))
        streams.append({"name": s.name, "auto_subscribe": s.auto_subscribe, "groups": groups})
    return {"contract": plan.contract_id, "streams": streams, "tables": tables, "lookups": {x.lookup_id: lookup_sql(x) for x in plan.lookups()}}
