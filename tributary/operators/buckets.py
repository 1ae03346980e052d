"""Documents, their buckets, and lookups.

A bucket is named 1#stream|group["v1","v2"]. Documents are put into buckets by
computing the names of their rows, so that any number of buckets is built in
one pass; a request's buckets are found by joining its few names.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.render import document, quoted
from ..plans.model import Binding, Lookup, Output, Plan, Projection, Query, RuleError, Stream
from ..plans.model import Column as Name
from .predicates import array_of, request_column, request_predicate, request_value, row_predicate

#: Bounds of one request: buckets named, and buckets that its values resolve to.
MAX_BUCKETS, MAX_RESOLVED = 256, 10_000


def computed(parts: Sequence, df: DataFrame) -> Column:
    """A column, or a concatenation that must not be null."""
    if len(parts) == 1 and isinstance(parts[0], Name):
        return df[f"`{parts[0].name}`"]
    text = F.concat(*[df[f"`{p.name}`"].cast("string") if isinstance(p, Name) else F.lit(p.value) for p in parts])
    return F.when(text.isNotNull(), text).otherwise(F.raise_error(F.lit("a concatenated column is null")).cast("string"))


def fields(projection: Projection, df: DataFrame) -> list[tuple[str, Column]]:
    outputs = [(o.alias, computed(o.parts, df)) for o in projection.outputs]
    if not projection.star:
        return outputs
    star = {c: df[f"`{c}`"] for c in sorted(df.columns, key=str.encode)}
    return list((star | dict(outputs)).items())


def object_id(q: Query, df: DataFrame) -> Column:
    parts = next((o.parts for o in q.projection.outputs if o.alias == "id"), (Name("id"),))
    return computed(parts, df).cast("string")


def check_columns(q: Query, df: DataFrame) -> None:
    """Projected and routing columns must be there."""
    named = q.projection.outputs if any(o.alias == "id" for o in q.projection.outputs) else (*q.projection.outputs, Output("id", (Name("id"),)))
    missing = [p.name for o in named for p in o.parts if isinstance(p, Name) and p.name not in df.columns] + [p.column for p in q.parameters if p.column not in df.columns]
    if missing:
        raise RuleError(f"{q.source} has no column {missing[0]}")


def group_name(stream: str, group: int) -> str:
    return f"1#{stream}|{group}"


def bucket_name(stream: str, group: int, values: Sequence[Column]) -> Column:
    inner = list(itertools.chain.from_iterable((F.lit(","), quoted(v)) for v in values))[1:]
    return F.concat(F.lit(f"{group_name(stream, group)}["), *inner, F.lit("]"))


def bucket_text(stream: str, group: int, values: Sequence[str]) -> str:
    return f"{group_name(stream, group)}{json.dumps(list(values), ensure_ascii=False, separators=(',', ':'))}"


def parse_bucket(name: str) -> tuple[str, int, list[str]]:
    m = re.fullmatch(r"1#(.+?)\|(\d+)(\[.*\])", name, re.S)
    try:
        values = json.loads(m[3]) if m else None
    except ValueError:
        values = None
    if values is None or not all(isinstance(v, str) for v in values):
        raise RuleError(f"not a bucket name: {name}")
    return m[1], int(m[2]), values


def query_rows(q: Query, df: DataFrame) -> DataFrame:
    """(object_type, object_id, data, routes) of one query: routes has the values of its parameters; a row is repeated
    for each element of an array it is routed by. A null route is an error, as a document must have its place."""
    check_columns(q, df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    kept = df.filter(row_predicate(q.row_filter, df)) if q.row_filter is not None else df
    columns = [F.lit(q.output).alias("object_type"), object_id(q, kept).alias("object_id"), document(kept, fields(q.projection, kept)).alias("data")]
    routes = []
    for i, p in enumerate(q.parameters):
        c = kept[f"`{p.column}`"]
        if p.array:
            routes.append(F.coalesce(F.array_distinct(array_of(c, kinds[p.column])), F.array(c.cast("string")) if not isinstance(kinds[p.column], T.ArrayType) else F.array().cast("array<string>")))
        else:
            text = c.cast("string")
            routes.append(F.array(F.when(text.isNotNull(), text).otherwise(F.raise_error(F.lit(f"{q.source}.{p.column} is null and routes a document")).cast("string"))))
    out = kept.select(*columns, *[r.alias(f"r{i}") for i, r in enumerate(routes)])
    for i, p in enumerate(q.parameters):
        out = out.withColumn(f"r{i}", F.explode(f"r{i}") if p.array else F.col(f"r{i}")[0])
    return out.select("object_type", "object_id", "data", F.array(*[F.col(f"r{i}") for i in range(len(q.parameters))]).cast("array<string>").alias("routes"))


def stream_rows(stream: Stream, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(bucket, object_type, object_id, data) of all buckets of a stream. In one bucket the first query of its group
    that has a document gives it."""
    parts = []
    for g, queries in enumerate(stream.groups()):
        rows = [query_rows(q, tables[q.source]).withColumn("nth", F.lit(i)) for i, q in enumerate(queries)]
        union = reduce(DataFrame.unionByName, rows)
        named = union.withColumn("bucket", bucket_name(stream.name, g, [F.col("routes")[i] for i in range(len(queries[0].parameters))]))
        if len({q.source for q in queries}) < len(queries):
            named = named.groupBy("bucket", "object_type", "object_id").agg(F.min_by("data", "nth").alias("data"))
        parts.append(named.select("bucket", "object_type", "object_id", "data"))
    return reduce(DataFrame.unionByName, parts)


def plan_rows(plan: Plan, tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [stream_rows(s, tables) for s in plan.streams])


def default_buckets(plan: Plan, request: Mapping[str, Mapping]) -> list[str]:
    """Buckets of streams subscribed by default: groups without parameters whose request filter passes."""
    return [bucket_text(s.name, g, []) for s in plan.streams if s.auto_subscribe for g, qs in enumerate(s.groups()) if not qs[0].parameters and request_predicate(qs[0].request_filter, request)]


def lookup_view(lookup: Lookup, rows: DataFrame) -> DataFrame:
    """(k0, k1, ..., value) of the rows of a lookup's table; a null key, value or failed test has no entry."""
    for name in [k for k, _ in lookup.keys] + [lookup.selected] + [c for c, _, _ in lookup.row_filter]:
        if name not in rows.columns:
            raise RuleError(f"{lookup.table} has no column {name}")
        if not isinstance(rows.schema[name].dataType, T.StringType):
            raise RuleError(f"lookup column {lookup.table}.{name} is not text")
    kept = rows
    for c, text, same in lookup.row_filter:
        col = rows[f"`{c}`"]
        kept = kept.filter((col.isNull() if same else col.isNotNull()) if text is None else col == text)
    keys = [kept[f"`{c}`"].alias(f"k{i}") for i, (c, _) in enumerate(lookup.keys)]
    return kept.select(*keys, kept[f"`{lookup.selected}`"].alias("value")).dropna()


def lookup_values(lookup: Lookup, rows: DataFrame, requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joins the columns of requests named in keys with the lookup; adds value. Each distinct value once a request."""
    view = lookup_view(lookup, rows).distinct()
    joined = requests.join(view, [requests[k] == view[f"k{i}"] for i, k in enumerate(keys)])
    return joined.select(*[requests[c] for c in requests.columns], "value").distinct()


def requested(plan: Plan, stream: str, requests: DataFrame, column: Callable[[Binding], Column], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The columns of requests and bucket, for many requests at once: what resolve() gives for each of them. column
    names the value of a binding in a request; arrays are JSON text, exploded, and lookups are joined."""
    parts = []
    for g, queries in enumerate(plan.stream(stream).groups()):
        q = queries[0]
        rows = requests if q.request_filter is None else requests.filter(request_column(q.request_filter, column))
        for i, p in enumerate(q.parameters):
            if p.binding.kind == "lookup":
                keys = {f"__k{j}": column(b).cast("string") for j, (_, b) in enumerate(q.lookup.keys)}
                found = lookup_values(q.lookup, (tables or {})[q.lookup.table], rows.withColumns(keys), list(keys))
                rows = found.drop(*keys).withColumnRenamed("value", f"__v{i}")
            elif p.binding.kind == "array":
                text = column(p.binding).cast("string")
                each = F.coalesce(F.from_json(text, "array<string>"), F.array(text))
                rows = rows.withColumn(f"__v{i}", F.explode(F.array_distinct(F.array_compact(each))))
            else:
                rows = rows.withColumn(f"__v{i}", column(p.binding).cast("string")).filter(F.col(f"__v{i}").isNotNull())
        parts.append(rows.select(*requests.columns, bucket_name(stream, g, [F.col(f"__v{i}") for i in range(len(q.parameters))]).alias("bucket")))
    return reduce(DataFrame.unionByName, parts).distinct()


def resolve(plan: Plan, stream: str, request: Mapping[str, Mapping], tables: Mapping[str, DataFrame] | None = None) -> list[str]:
    """The bucket names of a subscription: the product of the values of its parameters. A value that is missing
    resolves to nothing. Only this request's values reach the driver, and their number is bounded."""
    out: list[str] = []
    for g, queries in enumerate(plan.stream(stream).groups()):
        q = queries[0]
        if not request_predicate(q.request_filter, request):
            continue
        choices: list[list[str]] = []
        for p in q.parameters:
            if p.binding.kind == "lookup":
                wanted = [request_value(b, request) for _, b in q.lookup.keys]
                if any(w is None for w in wanted) or tables is None:
                    choices.append([])
                    continue
                view = lookup_view(q.lookup, tables[q.lookup.table])
                for i, w in enumerate(wanted):
                    view = view.filter(F.col(f"k{i}") == str(w))
                found = [r["value"] for r in view.select("value").distinct().limit(MAX_RESOLVED + 1).collect()]
            else:
                found = values_of(p.binding, request_value(p.binding, request))
            choices.append(sorted(found))
        total = 1
        for c in choices:
            total *= len(c)
        if total + len(out) > MAX_RESOLVED:
            raise RuleError(f"more than {MAX_RESOLVED} buckets")
        out += [bucket_text(stream, g, values) for values in itertools.product(*choices)]
    return list(dict.fromkeys(out))


def values_of(binding: Binding, given) -> list[str]:
    """A value as a list of texts: the elements of an array binding (a value that is no array is its own element)."""
    if given is None:
        return []
    if binding.kind == "array":
        if isinstance(given, str):
            try:
                given = json.loads(given)
            except ValueError:
                pass
        given = given if isinstance(given, list) else [given]
        return list(dict.fromkeys(text for x in given if (text := scalar(x)) is not None))
    text = scalar(given)
    return [] if text is None else [text]


def scalar(x) -> str | None:
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, (str, int)) else None


