"""Signed requests as Column expressions: keyed hashes of proxied requests, and HTTP message signatures of agents."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from pagelens.functions import urls
from pagelens.functions.money_text import let

MAX_AGE, PROXY_SKEW, SKEW = 90, 5, 300  # seconds: age of a proxied request, and clocks that differ


def hmac_sha256(message: Column, secret: str) -> Column:
    """Hexadecimal HMAC-SHA256 of a text; the key's pads are literals."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def parameters(url: Column) -> Column:
    """ARRAY<STRUCT<name, value>> of a URL's query, decoded, in order."""
    decoded = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    pairs = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("name"), decoded(F.regexp_extract(p, "=(.*)$", 1)).alias("value")))


def _first(pairs: Column, name: str) -> Column:
    return F.get(F.filter(pairs, lambda p: p["name"] == name), F.lit(0))["value"]


def proxy_message(pairs: Column) -> Column:
    """What the signature of a proxied request covers: its other parameters as name=value, values of one name joined by commas, in order."""
    rest = F.filter(pairs, lambda p: p["name"] != "signature")
    names = F.array_distinct(F.transform(rest, lambda p: p["name"]))
    return F.array_join(F.array_sort(F.transform(names, lambda n: F.concat(n, F.lit("="), F.array_join(F.transform(F.filter(rest, lambda p: p["name"] == n), lambda p: p["value"]), ",")))), "")


def proxy_signed(url: Column, secret: str) -> Column:
    """Whether a proxied request's signature parameter is the keyed hash of the others. All digits are compared, by hash."""

    def check(pairs: Column) -> Column:
        given = F.lower(_first(pairs, "signature"))
        return F.coalesce((given != "") & (F.sha2(given, 256) == F.sha2(hmac_sha256(proxy_message(pairs), secret), 256)), F.lit(False))

    return let(parameters(url), check)


def is_fresh(stamp: Column, now: Column) -> Column:
    """Whether a time in whole seconds lies at most MAX_AGE before now, clocks allowed for."""
    age = now - F.when(stamp.rlike("^[0-9]{1,18}$"), stamp.cast("long"))
    return F.coalesce((age <= MAX_AGE + PROXY_SKEW) & (age >= -PROXY_SKEW), F.lit(False))


_KEY, _QUOTED = r"[a-zA-Z0-9_.*-]+", r'"(?:[^"\\]|\\.)*"'
_PARAM = rf";[ \t]*{_KEY}(?:=(?:{_QUOTED}|[^;,\s\"][^;,\s]*))?"
_MEMBER = rf"{_KEY}=\([ \t]*(?:{_QUOTED}[ \t]*)*\)(?:{_PARAM})*"
_ENTRY = rf"{_KEY}=:[^:]*:(?:{_PARAM})*"
_LIST = r"(?s)^[ \t]*(?:{0}[ \t]*(?:,[ \t]*{0}[ \t]*)*(?:,[ \t]*)?)?$"


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, '^"|"$', ""), r"\\(.)", "$1")


def _parameter(tail: Column, name: str) -> Column:
    """The last parameter of a name as it is written, an empty text if it has no value."""
    found = F.filter(F.regexp_extract_all(tail, F.lit(f"({_PARAM})"), F.lit(1)), lambda p: p.rlike(rf"^;[ \t]*{name}(?:=|$)"))
    return F.try_element_at(F.transform(found, lambda p: F.regexp_extract(p, r"(?s)^;[ \t]*[^=]*=(.*)$", 1)), F.lit(-1))


def signature_input(value: Column, signature: Column) -> Column:
    """STRUCT<label, raw, components, alg, keyid, created, expires, signature> of the first signature that both headers have; null if one does not parse or there is none."""
    members, entries = F.regexp_extract_all(value, F.lit(f"({_MEMBER})"), F.lit(1)), F.regexp_extract_all(signature, F.lit(f"({_ENTRY})"), F.lit(1))
    label = lambda x: F.regexp_extract(x, f"^({_KEY})=", 1)
    given = lambda name: F.try_element_at(F.filter(entries, lambda e: label(e) == name), F.lit(-1))
    both = F.transform(F.filter(members, lambda m: given(label(m)).isNotNull()), lambda m: F.struct(label(m).alias("label"), F.regexp_extract(m, f"(?s)^{_KEY}=(.*)$", 1).alias("raw"), F.regexp_extract(given(label(m)), ":([^:]*):", 1).alias("signature")))

    def parts(m: Column) -> Column:
        inner, tail = F.regexp_extract(m["raw"], rf"(?s)^(\([ \t]*(?:{_QUOTED}[ \t]*)*\))", 1), F.regexp_extract(m["raw"], rf"(?s)^\([ \t]*(?:{_QUOTED}[ \t]*)*\)(.*)$", 1)
        number = lambda n: F.when(_parameter(tail, n).rlike("^-?[0-9]{1,18}$"), _parameter(tail, n).cast("long"))
        keyid = _parameter(tail, "keyid")
        return F.struct(
            m["label"].alias("label"), m["raw"].alias("raw"), F.transform(F.regexp_extract_all(inner, F.lit(f"({_QUOTED})"), F.lit(1)), lambda c: F.lower(_unquoted(c))).alias("components"), _unquoted(_parameter(tail, "alg")).alias("alg"),
            F.when(~keyid.rlike("^-?[0-9]+$"), F.nullif(_unquoted(keyid), F.lit(""))).alias("keyid"), number("created").alias("created"), number("expires").alias("expires"), m["signature"].alias("signature"),
        )

    return F.when(value.rlike(_LIST.format(_MEMBER)) & signature.rlike(_LIST.format(_ENTRY)), let(F.get(both, F.lit(0)), lambda m: F.when(m.isNotNull(), parts(m))))


def agent_origin(value: Column) -> Column:
    """Origin that the first item of a Signature-Agent header names."""
    first = F.trim(F.get(F.split(value, ","), F.lit(0)))
    bare = F.when(first.startswith('"'), F.when(first.rlike(f"^{_QUOTED}"), _unquoted(F.regexp_extract(first, f"^({_QUOTED})", 1)))).otherwise(first)
    return F.nullif(F.regexp_replace(urls.origin(F.when(bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), bare).otherwise(F.concat(F.lit("https://"), bare))), "^[a-z][a-z0-9+.-]*://$", ""), F.lit(""))


def _component(name: Column, headers: Column, method: Column, url: Column) -> Column:
    path, query = urls.path(url), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    derived = (
        F.when(name == "@method", F.upper(method)).when(~urls.is_absolute(url), F.lit(None).cast("string")).when(name == "@authority", F.regexp_replace(urls.origin(url), "^[^/]*//", "")).when(name == "@scheme", F.lower(F.regexp_extract(url, "^([^:]*):", 1)))
        .when(name == "@path", path).when(name == "@query", F.when(query == "", "?").otherwise(query)).when(name == "@request-target", F.concat(path, query)).when(name == "@target-uri", F.concat(urls.origin(url), path, query))
    )
    return F.when(name.startswith("@"), derived).otherwise(F.trim(F.array_join(F.try_element_at(headers, name), ", ")))


_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P


def _add(p: tuple, q: tuple) -> tuple:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % _P, (p[1] + p[0]) * (q[1] + q[0]) % _P
    c, d = 2 * p[3] * q[3] * _D % _P, 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


@lru_cache(maxsize=256)
def _point(raw: bytes) -> tuple | None:
    """The curve point of 32 bytes, null if there is none."""
    y = int.from_bytes(raw, "little") & (2**255 - 1)
    if y >= _P:
        return None
    square = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * pow(2, (_P - 1) // 4, _P) % _P
    if (x * x - square) % _P or not x and raw[31] >> 7:
        return None
    x = _P - x if x & 1 != raw[31] >> 7 else x
    return x, y, 1, x * y % _P


_BASE = (4 * pow(5, -1, _P) % _P).to_bytes(32, "little")
_WINDOW = 4  # bits of a factor that a table has the multiples for


@lru_cache(maxsize=64)
def _multiples(raw: bytes) -> list[list[tuple]]:
    """For each _WINDOW bits of a factor all their multiples of the point of 32 bytes, so that a product takes a sum for each."""
    out, p = [], _point(raw)
    for _ in range(-(-256 // _WINDOW)):
        own = [(0, 1, 1, 0)]
        for _ in range(2**_WINDOW - 1):
            own.append(_add(own[-1], p))
        out.append(own)
        p = _add(own[-1], p)
    return out


def _product(n: int, raw: bytes) -> tuple:
    out = (0, 1, 1, 0)
    for own in _multiples(raw):
        if n & 2**_WINDOW - 1:
            out = _add(out, own[n & 2**_WINDOW - 1])
        n >>= _WINDOW
    return out


@lru_cache(maxsize=16384)
def ed25519_verifies(public: bytes, message: bytes, signature: bytes) -> bool:
    """Whether an Ed25519 signature is one of a message by a public key; one that is sent again is not computed again."""
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(public), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= _L:
        return False
    k = int.from_bytes(hashlib.sha512(signature[:32] + public + message).digest(), "little") % _L
    left, right = _product(s, _BASE), _add(r, _product(k, public))
    return not ((left[0] * right[2] - right[0] * left[2]) % _P or (left[1] * right[2] - right[1] * left[2]) % _P)


@F.udf(BooleanType(), useArrow=True)
def _verified(base: str | None, signature: bytes | None, key: str | None) -> bool | None:
    if base is None or signature is None or key is None:
        return None
    try:
        return ed25519_verifies(base64.urlsafe_b64decode(key + "=" * (-len(key) % 4)), base.encode(), bytes(signature))
    except ValueError:
        return False


def verify_agents(requests: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """requests (request, headers by lower-case name, method, url) with verified, keyid and reason, null where verified.

    registry: origin, keyid, alg, x (public key in base64url), one row for each key; it is joined twice, on the origin and on the key.
    Only requests that pass all other tests reach the arithmetic of the curve.
    """
    raw = lambda name: F.array_join(F.try_element_at("headers", F.lit(name)), ", ")
    read = requests.select("request", "headers", "method", "url", raw("signature").alias("s"), raw("signature-input").alias("si"), raw("signature-agent").alias("sa")).withColumn("m", signature_input(F.col("si"), F.col("s"))).withColumn("origin", agent_origin(F.col("sa")))
    known = registry.select(F.lower("origin").alias("origin")).distinct().withColumn("agent", F.lit(True))
    keys = registry.select(F.lower("origin").alias("origin"), F.col("keyid").alias("registered"), F.col("alg").alias("key_alg"), "x")
    joined = read.join(known, "origin", "left").join(keys, (read["origin"] == keys["origin"]) & (F.col("m.keyid") == F.col("registered")), "left").drop(keys["origin"])
    lines = F.transform("m.components", lambda c: F.concat(F.lit('"'), c, F.lit('": '), _component(c, F.col("headers"), F.col("method"), F.col("url"))))
    base = F.when(F.forall(lines, lambda x: x.isNotNull()), F.concat(F.array_join(lines, "\n"), F.lit('\n"@signature-params": '), F.col("m.raw")))
    b64 = F.col("m.signature").rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length("m.signature") % 4 == 0)
    covered = F.array_contains("m.components", "@authority") & F.array_contains("m.components", "signature-agent")
    tests = [
        (F.col("s").isNull() | F.col("si").isNull(), "no-signature"), (F.col("m").isNull() | ~covered, "malformed"), (F.col("m.alg").isNotNull() & (F.col("m.alg") != "ed25519"), "unsupported-alg"), (F.col("sa").isNull() | F.col("origin").isNull() | F.col("agent").isNull(), "unknown-agent"),
        (F.col("m.keyid").isNull(), "malformed"), (F.col("registered").isNull(), "unknown-key"), (F.col("key_alg") != "ed25519", "unsupported-alg"),
        (F.col("m.created").isNull() | F.col("m.expires").isNull() | (F.col("m.created") > F.col("m.expires")), "malformed"), (F.col("m.created") - SKEW > now, "created-in-future"), (F.col("m.expires") + SKEW < now, "expired"), (base.isNull() | ~b64, "malformed"),
    ]
    reason = F.coalesce(*[F.when(test, F.lit(name)) for test, name in tests])
    unread = F.coalesce(tests[0][0] | tests[1][0] | tests[2][0], F.lit(False))  # the key's name is not looked at
    rows = joined.select("request", F.when(~unread, F.col("m.keyid")).alias("keyid"), reason.alias("reason"), F.when(reason.isNull(), base).alias("base"), F.when(reason.isNull(), F.unbase64("m.signature")).alias("signature"), "x")
    verified = F.coalesce(_verified("base", "signature", "x"), F.lit(False))
    return rows.withColumn("verified", verified).select("request", "verified", "keyid", F.when(~F.col("verified"), F.coalesce("reason", F.lit("bad-signature"))).alias("reason"))
