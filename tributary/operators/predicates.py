"""Rule predicates as column expressions, two-valued throughout.

A missing column makes a comparison false. A string column also equals an
integer or boolean literal to its right that it spells, but not to its left.
In a request, the empty string counts as null.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import Binding, Compare, IsNull, Literal, Logic, Predicate, RuleError
from ..plans.model import Column as Name

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def row_predicate(p: Predicate | None, df: DataFrame) -> Column:
    """Never null."""
    if p is None:
        return F.lit(True)
    if isinstance(p, Logic):
        out = row_predicate(p.terms[0], df)
        for t in p.terms[1:]:
            out = out & row_predicate(t, df) if p.op == "AND" else out | row_predicate(t, df)
        return out
    names = {f.name: f.dataType for f in df.schema.fields}
    if isinstance(p, IsNull):
        if p.operand.name not in names:
            return F.lit(not p.negated)
        c = df[f"`{p.operand.name}`"]
        return c.isNotNull() if p.negated else c.isNull()
    if p.op == "IN":
        if isinstance(p.right, tuple):
            out = F.lit(False)
            for v in p.right:
                out = out | equal(p.left, v, names, df)
            return out
        if isinstance(p.right, Name) and p.right.name in names:
            return member(p.left, p.right, names, df)
        return equal(p.left, p.right, names, df)
    return equal(p.left, p.right, names, df)


def operand(o, names: Mapping[str, T.DataType], df: DataFrame) -> tuple[Column, T.DataType] | None:
    if isinstance(o, Name):
        return (df[f"`{o.name}`"], names[o.name]) if o.name in names else None
    if isinstance(o, Literal):
        kind = T.NullType() if o.value is None else T.BooleanType() if isinstance(o.value, bool) else T.LongType() if isinstance(o.value, int) else T.StringType()
        return F.lit(o.value), kind
    raise RuleError("a request value is not part of a row")


def equal(left, right, names: Mapping[str, T.DataType], df: DataFrame) -> Column:
    a, b = operand(left, names, df), operand(right, names, df)
    if a is None or b is None:
        return F.lit(False)
    (x, s), (y, t) = a, b
    if isinstance(s, T.NullType) or isinstance(t, T.NullType):
        return x.isNull() & y.isNull()
    if isinstance(s, T.StringType) and isinstance(t, T.LongType) and isinstance(right, Literal):
        same = x == str(right.value)
    elif isinstance(s, T.StringType) and isinstance(t, NUMBERS):
        same = x.try_cast("decimal(20,0)") == y
    elif isinstance(s, T.StringType) and isinstance(t, T.BooleanType):
        same = F.lower(x) == F.lower(y.cast("string"))
    elif isinstance(s, NUMBERS) and isinstance(t, NUMBERS) or type(s) is type(t):
        return x.eqNullSafe(y)
    else:
        return F.lit(False)
    return F.coalesce(same, F.lit(False)) | (x.isNull() & y.isNull())


def array_of(c: Column, kind: T.DataType) -> Column:
    """The scalar elements of an array column or of JSON text, as strings; null if it is not an array."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: x.cast("string"))
    if isinstance(kind, T.StringType):
        return F.from_json(F.when(F.ltrim(c).startswith("["), c), T.ArrayType(T.StringType()))
    return F.lit(None).cast("array<string>")


def member(left, right: Name, names: Mapping[str, T.DataType], df: DataFrame) -> Column:
    """left is an element of the array in right, or equals it if it is no array."""
    a = operand(left, names, df)
    if a is None:
        return F.lit(False)
    elements = array_of(df[f"`{right.name}`"], names[right.name])
    inside = F.array_contains(elements, a[0].cast("string"))
    whole = F.lit(False) if isinstance(names[right.name], T.ArrayType) else equal(right, left, names, df) | equal(left, right, names, df)
    return F.coalesce(F.when(elements.isNotNull(), inside).otherwise(whole), F.lit(False))


def request_value(o, request: Mapping[str, Mapping], values: bool = True):
    """The value of an operand in a request: {auth, claims, subscription, connection, parameters}."""
    if isinstance(o, Literal):
        return o.value
    if not isinstance(o, Binding):
        raise RuleError("a column is not part of a request")
    auth, claims = request.get("auth", {}), request.get("claims", {})
    if o.kind == "user_id":
        return claims.get("sub", claims.get("user_id"))
    # what a client says never stands for what it is authorised for
    where = {"auth": [auth, claims], "claim": [claims], "subscription": [request.get("subscription", {})], "connection": [request.get("parameters", {})], "request": [request.get("parameters", {})], "array": [request.get("parameters", {})]}
    if o.kind not in where:
        raise RuleError(f"{o.kind} has no value in a request")
    return next((m[o.name] for m in where[o.kind] if o.name in m), None)


def request_predicate(p: Predicate | None, request: Mapping[str, Mapping]) -> bool:
    """Decided before any row is read. Empty strings count as null; IN never matches."""
    if p is None:
        return True
    if isinstance(p, Logic):
        return (all if p.op == "AND" else any)(request_predicate(t, request) for t in p.terms)
    if isinstance(p, IsNull):
        return (request_value(p.operand, request) in (None, "")) != p.negated
    if p.op == "IN":
        return False
    a, b = request_value(p.left, request), request_value(p.right, request)
    if isinstance(a, Literal) or isinstance(p.left, Literal):
        a, b = b, a
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, str) and isinstance(b, bool):
        return a.lower() == str(b).lower()
    if isinstance(a, str) and isinstance(b, int):
        return a == str(b)
    return type(a) is type(b) and a == b


def request_column(p: Predicate | None, value) -> Column:
    """The same test on a DataFrame of requests: value(binding) gives a string column."""
    if p is None:
        return F.lit(True)
    if isinstance(p, Logic):
        out = request_column(p.terms[0], value)
        for t in p.terms[1:]:
            out = out & request_column(t, value) if p.op == "AND" else out | request_column(t, value)
        return out
    if isinstance(p, IsNull):
        given = value(p.operand)
        none = given.isNull() | (given == "")
        return ~none if p.negated else none
    if p.op == "IN":
        return F.lit(False)
    side = lambda o: (F.lit(None) if o.value is None else F.lit(str(o.value).lower() if isinstance(o.value, bool) else str(o.value))) if isinstance(o, Literal) else value(o)
    return side(p.left).cast("string").eqNullSafe(side(p.right).cast("string"))
