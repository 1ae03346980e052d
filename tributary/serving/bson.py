"""BSON documents (bsonspec.org) of JSON values, and back. Integers take 32 bits if they fit, else 64."""

from __future__ import annotations

import struct


def element(name: str, value) -> bytes:
    key = name.encode()
    if b"\0" in key:
        raise ValueError("a BSON name cannot hold a zero byte")
    key += b"\0"
    match value:
        case None:
            return b"\x0a" + key
        case bool():
            return b"\x08" + key + bytes([value])
        case int() if -(1 << 31) <= value < 1 << 31:
            return b"\x10" + key + struct.pack("<i", value)
        case int() if -(1 << 63) <= value < 1 << 63:
            return b"\x12" + key + struct.pack("<q", value)
        case float():
            return b"\x01" + key + struct.pack("<d", value)
        case str():
            text = value.encode() + b"\0"
            return b"\x02" + key + struct.pack("<i", len(text)) + text
        case dict():
            return b"\x03" + key + encode(value)
        case list() | tuple():
            return b"\x04" + key + encode({str(i): v for i, v in enumerate(value)})
    raise ValueError(f"no BSON for {type(value).__name__} {value!r}"[:80])


def encode(document: dict) -> bytes:
    body = b"".join(element(k, v) for k, v in document.items())
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def decode(data: bytes) -> dict:
    """One whole document."""
    size = struct.unpack_from("<i", data)[0] if len(data) >= 5 else 0
    if not size or size != len(data) or data[-1]:
        raise ValueError("not a whole BSON document")
    out, at = {}, 4
    while data[at]:
        kind, end = data[at], data.index(b"\0", at + 1)
        name, at = data[at + 1 : end].decode(), end + 1
        if kind == 0x0A:
            out[name] = None
        elif kind == 0x08:
            out[name], at = bool(data[at]), at + 1
        elif kind in (0x10, 0x12, 0x01):
            code, n = {0x10: ("<i", 4), 0x12: ("<q", 8), 0x01: ("<d", 8)}[kind]
            out[name], at = struct.unpack_from(code, data, at)[0], at + n
        elif kind == 0x02:
            n = struct.unpack_from("<i", data, at)[0]
            out[name], at = data[at + 4 : at + 3 + n].decode(), at + 4 + n
        elif kind in (0x03, 0x04):
            n = struct.unpack_from("<i", data, at)[0]
            inner = decode(data[at : at + n])
            out[name], at = (list(inner.values()) if kind == 0x04 else inner), at + n
        else:
            raise ValueError(f"BSON type {kind:#x} is not supported")
    return out
