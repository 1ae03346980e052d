"""Canonical document text and checksums, as column expressions.

A document's JSON text is hashed, so key order and number format matter: it is
put together from the JSON text of each value, in a given order, null included.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U32 = 1 << 32


def quoted(text: Column) -> Column:
    """A JSON string; non-ASCII characters stay as they are."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.char_length(whole) - 2)


def number_text(x: Column) -> Column:
    """Shortest text of a double that reads back the same: plain digits from 1e-5 up to 1e16, else an exponent.

    Values that are not finite become strings."""
    short = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(short.cast(T.DecimalType(38, 21)).cast("string"), r"0+$", ""), r"\.$", ".0")
    power = F.regexp_replace(F.lower(short), r"\.0e", "e")
    size = F.abs(x)
    finite = F.when(short.contains("E") & (size >= 1e-5) & (size < 1e16), plain).when(short.contains("E"), power).otherwise(short)
    return F.when(F.isnan(x) | (size == float("inf")), quoted(short)).otherwise(finite)


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def timestamp_from_text(text: Column) -> Column:
    """ISO text with a blank or T, an optional fraction and zone, to six fractional digits. A zone that is UTC becomes
    Z, any other stays; a date alone keeps its text and gets the fraction; other text passes through."""
    shape = r"^(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2}:\d{2}))?(?:\.(\d{1,}))?(Z|[+-]\d{2}(?::?\d{2})?)?$"
    part = lambda i: F.regexp_extract(text, shape, i)
    zone = F.when(part(4).isin("", "Z", "+00", "+00:00", "+0000"), "Z").otherwise(part(4))
    clock = F.when(part(2) == "", "").otherwise(F.concat(F.lit("T"), part(2)))
    fraction = F.substring(F.rpad(part(3), 6, "0"), 1, 6)
    return F.when(text.rlike(shape), F.concat(part(1), clock, F.lit("."), fraction, zone)).otherwise(text)


def number_from_text(text: Column) -> Column:
    """JSON text of a number given as text: an integer, else a finite double, else a string."""
    whole, real = text.try_cast("decimal(20,0)"), text.try_cast("double")
    integer = text.rlike(r"^[+-]?\d+$") & whole.between(F.lit(Decimal(-(1 << 63))), F.lit(Decimal((1 << 64) - 1)))
    finite = real.isNotNull() & ~F.isnan(real) & (F.abs(real) != float("inf")) & text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(integer, whole.cast("string")).when(finite, number_text(real)).otherwise(quoted(text))


def boolean_from_text(text: Column) -> Column:
    return F.when(text.isin("t", "true", "TRUE"), "true").when(text.isin("f", "false", "FALSE"), "false").otherwise(quoted(text))


def json_from_text(text: Column) -> Column:
    """JSON text of a JSON column: kept if it parses, else a string."""
    return F.when(F.try_parse_json(text).isNotNull(), F.to_json(F.try_parse_json(text))).otherwise(quoted(text))


def value_text(value: Column, kind: T.DataType) -> Column:
    """JSON text of a typed value."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        text = value.cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        text = number_text(value.cast("double"))
    elif isinstance(kind, T.DateType):
        text = quoted(F.concat(value.cast("string"), F.lit(".000000Z")))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = quoted(timestamp_text(value))
    elif isinstance(kind, T.VariantType):
        text = F.to_json(value)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(value, {"ignoreNullFields": "false"})
    elif isinstance(kind, T.BinaryType):
        text = quoted(F.concat(F.lit("\\x"), F.lower(F.hex(value))))
    else:
        text = quoted(value.cast("string"))
    return F.coalesce(text, F.lit("null"))


def document(df: DataFrame, fields: Sequence[tuple[str, Column]]) -> Column:
    """JSON object of (name, value) in the given order. Types are taken from df."""
    kinds = df.select(*[c.alias(f"f{i}") for i, (_, c) in enumerate(fields)]).schema
    parts: list[Column] = []
    for i, (name, value) in enumerate(fields):
        parts += [quoted(F.lit(name)), F.lit(":"), value_text(value, kinds[i].dataType), F.lit("," if i + 1 < len(fields) else "")]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def row_document(df: DataFrame) -> Column:
    """All columns, in byte order of their names."""
    return document(df, [(c, df[f"`{c}`"]) for c in sorted(df.columns, key=str.encode)])


def first_u32(text: Column) -> Column:
    """The first four bytes of SHA-256, little-endian."""
    h = F.sha2(text.cast("binary"), 256)
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")


def put_checksum(kind: Column, ident: Column, data: Column) -> Column:
    return first_u32(F.concat(F.lit("put."), kind, F.lit("."), ident, F.lit("."), data))


def remove_checksum(subkey: Column) -> Column:
    """Of a removed document, by its subkey type/id."""
    return first_u32(F.concat(F.lit("delete."), subkey))


def wrapped(total: Column) -> Column:
    """A sum of unsigned 32-bit numbers, wrapped."""
    return F.pmod(total, F.lit(U32))


def signed(unsigned: Column) -> Column:
    return F.when(unsigned >= U32 // 2, unsigned - U32).otherwise(unsigned)


def checksum_sum(column: str = "checksum") -> Column:
    """Aggregate: the wrapped sum, 0 for no rows."""
    return wrapped(F.coalesce(F.sum(column), F.lit(0)).cast("long"))


def lsn_text(lsn: Column) -> Column:
    """HI/LO in hexadecimal."""
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit(U32 - 1))))


def lsn_value(text: Column) -> Column:
    hi, lo = (F.conv(F.split_part(text, F.lit("/"), F.lit(i)), 16, 10).cast("long") for i in (1, 2))
    return F.shiftleft(hi, 32) + lo
