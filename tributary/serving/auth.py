"""Tokens: JSON Web Tokens (RFC 7519) of users, and API tokens of operators."""

from __future__ import annotations

import base64
import binascii
import hashlib
import hmac
import json
import math
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

#: DER prefix of a SHA-256 digest in an RSASSA-PKCS1-v1_5 signature (RFC 8017, 9.2). Fixed value.
SHA256_DER = bytes.fromhex("3031300d060960864801650304020105000420")
#: Seconds that a token's start may lie ahead.
LEEWAY = 60


class AuthError(Exception):
    """A request without a valid token; status is 401."""

    status = 401

    def body(self) -> dict:
        return {"error": str(self), "code": "AUTH_REQUIRED"}


@dataclass(frozen=True)
class Secret:
    """A shared key, for HS256."""

    secret: bytes
    kid: str | None = None


@dataclass(frozen=True)
class PublicKey:
    """An RSA key, for RS256."""

    n: int
    e: int
    kid: str | None = None


@dataclass(frozen=True)
class Token:
    claims: Mapping
    exp: int
    user_id: str | None

    def seconds_left(self, now: float | None = None) -> float:
        return max(0.0, self.exp - (time.time() if now is None else now))

    def request(self, parameters: Mapping | None = None) -> dict[str, Mapping]:
        """The request that rules are resolved for. Parameters come from the client and bind nothing of auth."""
        claims = flatten(self.claims)
        return {"auth": flatten(self.claims.get("parameters") or {}) if isinstance(self.claims.get("parameters"), Mapping) else {}, "claims": claims, "parameters": parameters or {}}


def flatten(value: Mapping, prefix: str = "") -> dict[str, str]:
    """Nested objects as dotted names with texts; nulls are absent, arrays are JSON text."""
    out: dict[str, str] = {}
    for key, v in value.items():
        name = f"{prefix}.{key}" if prefix else key
        if isinstance(v, Mapping):
            out |= flatten(v, name)
        elif isinstance(v, str):
            out[name] = v
        elif v is not None:
            out[name] = json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return out


def b64url(text: str) -> bytes:
    if "=" in text:
        raise AuthError("the token is not accepted")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True)
    except (binascii.Error, ValueError):
        raise AuthError("the token is not accepted") from None


def seconds(value) -> int | None:
    """A NumericDate, fractions cut off."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value < 0:
        return None
    return int(value)


def rsa_holds(key: PublicKey, signed: bytes, signature: bytes) -> bool:
    size = (key.n.bit_length() + 7) // 8
    if len(signature) != size or int.from_bytes(signature) >= key.n:
        return False
    tail = b"\0" + SHA256_DER + hashlib.sha256(signed).digest()
    wanted = b"\0\1" + b"\xff" * (size - len(tail) - 2) + tail
    return size >= len(tail) + 10 and hmac.compare_digest(pow(int.from_bytes(signature), key.e, key.n).to_bytes(size), wanted)


def bearer(headers: Mapping[str, str]) -> str:
    """The token of an Authorization header: two words, the first Bearer or Token."""
    given = next((v for k, v in headers.items() if k.lower() == "authorization"), "").split()
    if len(given) != 2 or given[0].lower() not in ("bearer", "token"):
        raise AuthError("a token is needed: Authorization: Bearer ...")
    return given[1]


def parse_keys(text: str) -> list[Secret | PublicKey]:
    """The keys of a JSON Web Key Set (RFC 7517) that sign with HS256 or RS256; others are passed over, none is an
    error."""
    try:
        given = json.loads(text)["keys"]
        found: list[Secret | PublicKey] = []
        for k in given:
            if k.get("use", "sig") != "sig":
                continue
            if k.get("kty") == "oct" and k.get("alg", "HS256") == "HS256":
                found.append(Secret(b64url(k["k"]), k.get("kid")))
            elif k.get("kty") == "RSA" and k.get("alg", "RS256") == "RS256":
                found.append(PublicKey(int.from_bytes(b64url(k["n"])), int.from_bytes(b64url(k["e"])), k.get("kid")))
    except (ValueError, TypeError, KeyError, AttributeError, AuthError):
        raise ValueError("not a set of keys") from None
    if not found:
        raise ValueError("the set has no key for HS256 or RS256")
    return found


class SameOrigin(urllib.request.HTTPRedirectHandler):
    """Redirects are not followed: an address that was allowed must answer itself."""

    def redirect_request(self, *_):
        return None


def fetch_keys(url: str, timeout: float = 5.0, most: int = 1 << 20) -> list[Secret | PublicKey]:
    """The key set at an address: https, or http on the machine itself."""
    at = urllib.parse.urlsplit(url)
    local = at.hostname in ("localhost", "127.0.0.1", "::1")
    if not at.hostname or not (at.scheme == "https" or at.scheme == "http" and local):
        raise ValueError("keys come by https, or by http from this machine")
    try:
        with urllib.request.build_opener(SameOrigin).open(url, timeout=timeout) as answer:
            body = answer.read(most + 1)
    except OSError as error:
        raise ValueError(f"keys cannot be fetched: {error}") from None
    if len(body) > most:
        raise ValueError("the set of keys is too large")
    return parse_keys(body.decode())


@dataclass(frozen=True)
class Users:
    """Checks tokens of users; without keys nobody is let in, and a policy without values is not applied."""

    keys: Sequence[Secret | PublicKey] = ()
    audiences: Sequence[str] = ()
    issuers: Sequence[str] = ()
    clock: Callable[[], float] = time.time

    def key(self, kind: type, kid: str | None):
        """The key that a token names; a token that names none is checked with the only key of its kind."""
        own = [k for k in self.keys if isinstance(k, kind)]
        found = [k for k in own if k.kid == kid] if kid is not None else own
        if len(found) != 1:
            raise AuthError("the token is not accepted")
        return found[0]

    def verify(self, token: str) -> Token:
        parts = token.split(".")
        if len(parts) != 3:
            raise AuthError("the token is not accepted")
        try:
            header, claims = (json.loads(b64url(p)) for p in parts[:2])
        except ValueError:
            raise AuthError("the token is not accepted") from None
        if not isinstance(header, dict) or not isinstance(claims, dict):
            raise AuthError("the token is not accepted")
        signed, signature = ".".join(parts[:2]).encode(), b64url(parts[2])
        match header.get("alg"):
            case "HS256":
                right = hmac.compare_digest(hmac.digest(self.key(Secret, header.get("kid")).secret, signed, "sha256"), signature)
            case "RS256":
                right = rsa_holds(self.key(PublicKey, header.get("kid")), signed, signature)
            case _:
                right = False
        if not right:
            raise AuthError("the token is not accepted")
        return self.accept(claims)

    def accept(self, claims: Mapping) -> Token:
        """The claims that a valid signature covers: exp is required."""
        now, exp = int(self.clock()), seconds(claims.get("exp"))
        begun = seconds(claims["nbf"]) if "nbf" in claims else 0
        aud = claims.get("aud")
        named = [aud] if isinstance(aud, str) else [a for a in aud if isinstance(a, str)] if isinstance(aud, list) else []
        fits = (not self.audiences or bool(set(named) & set(self.audiences))) and (not self.issuers or isinstance(claims.get("iss"), str) and claims["iss"] in self.issuers)
        if exp is None or exp <= now or begun is None or begun > now + LEEWAY or not fits:
            raise AuthError("the token is not accepted")
        return Token(claims, exp, next((claims[k] for k in ("sub", "user_id") if isinstance(claims.get(k), str)), None))

    def authorize(self, headers: Mapping[str, str]) -> Token:
        if not self.keys:
            raise AuthError("no keys are configured, so nobody is let in")
        return self.verify(bearer(headers))


@dataclass(frozen=True)
class ApiTokens:
    """Checks tokens of operators; without any, nothing is allowed."""

    tokens: Sequence[str] = ()

    def authorize(self, headers: Mapping[str, str]) -> None:
        if not self.tokens:
            raise AuthError("no keys are configured, so nobody is let in")
        given = bearer(headers).encode()
        if not any([hmac.compare_digest(given, t.encode()) for t in self.tokens]):
            raise AuthError("the token is not accepted")
