"""Addresses and URLs that may be fetched, as column functions."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

# Reserved ranges of IPv4, as first and last address and label, in the order that decides.
RANGES = [
    ("0.0.0.0", "0.255.255.255", "this-network (0.0.0.0/8)"), ("10.0.0.0", "10.255.255.255", "private (10.0.0.0/8)"), ("100.64.0.0", "100.127.255.255", "carrier-grade NAT (100.64.0.0/10)"),
    ("127.0.0.0", "127.255.255.255", "loopback (127.0.0.0/8)"), ("169.254.0.0", "169.254.255.255", "link-local / cloud metadata (169.254.0.0/16)"), ("172.16.0.0", "172.31.255.255", "private (172.16.0.0/12)"),
    ("192.0.0.0", "192.0.0.255", "IETF protocol assignments (192.0.0.0/24)"), ("192.168.0.0", "192.168.255.255", "private (192.168.0.0/16)"), ("198.18.0.0", "198.19.255.255", "benchmarking (198.18.0.0/15)"),
    ("224.0.0.0", "239.255.255.255", "multicast (224.0.0.0/4)"), ("240.0.0.0", "255.255.255.255", "reserved / broadcast (240.0.0.0/4)"),
]
# Reserved ranges of IPv6, as a pattern of its 32 hexadecimal digits and label; where the label ends in an arrow, an IPv4 address follows from the digit given.
RANGES6 = [
    ("^0{32}$", "unspecified (::)", None, True), ("^0{31}1$", "loopback (::1)", None, True), ("^0{20}ffff", "IPv4-mapped → ", 25, None), ("^0{24}", "IPv4-compatible → ", 25, True),
    ("^0064ff9b0{16}", "NAT64 64:ff9b::/96 → ", 25, None), ("^2002", "6to4 2002::/16 → ", 5, None), ("^01000{12}", "discard-only (100::/64)", None, True), ("^20010db8", "documentation (2001:db8::/32)", None, True),
    ("^f[cd]", "unique local (fc00::/7)", None, True), ("^fe[89ab]", "link-local (fe80::/10)", None, True), ("^ff", "multicast (ff00::/8)", None, True),
]
INTERNAL = [".localhost", ".local", ".internal"]

_TYPE = StructType([StructField("family", IntegerType()), StructField("reserved", BooleanType()), StructField("label", StringType())])


def _number(ip: str) -> int:
    return int.from_bytes(bytes(map(int, ip.split("."))))


_V4 = [(_number(a), _number(b), label) for a, b, label in RANGES]
_V6 = [(re.compile(pattern), label, at, reserved) for pattern, label, at, reserved in RANGES6]


def v4_number(text: str) -> int | None:
    octets = text.split(".")
    fine = len(octets) == 4 and all(re.fullmatch("[0-9]{1,3}", x) and int(x) < 256 for x in octets)
    return int.from_bytes(bytes(map(int, octets))) if fine else None


def v4_label(number: int) -> str:
    return next((label for a, b, label in _V4 if a <= number <= b), "public")


def v4_label_sql(number: str) -> str:
    """The label of an address as a number, as a SQL expression."""
    return "CASE " + " ".join(f"WHEN {number} BETWEEN {a} AND {b} THEN '{label}'" for a, b, label in _V4) + " ELSE 'public' END"


def v6_digits(text: str) -> str | None:
    """The 32 hexadecimal digits of an IPv6 literal, without brackets and with a zone or not; null if it is none."""
    try:
        return ipaddress.IPv6Address(text.split("%")[0]).packed.hex()
    except ValueError:
        return None


def classify(text: str) -> tuple[int, bool, str] | None:
    """Family, whether it is reserved, and label of a literal address; None if it is none."""
    bare = text.strip().removeprefix("[").removesuffix("]")
    number = v4_number(bare)
    if number is not None:
        return 4, v4_label(number) != "public", v4_label(number)
    digits = v6_digits(bare)
    if digits is None:
        return (6, True, "unparseable IPv6 literal") if ":" in bare else (4, True, "unparseable IPv4 literal") if re.fullmatch("[0-9.]+", bare) else None
    for pattern, label, at, reserved in _V6:
        if pattern.match(digits):
            inner = v4_label(int(digits[at - 1 : at + 7], 16)) if at else ""
            return 6, inner != "public" if reserved is None else reserved, label + inner
    return 6, False, "public"


@F.udf(_TYPE, useArrow=True)
def address(text: str | None):
    """STRUCT<family, reserved, label> of a literal address; null if it is none."""
    return None if text is None else classify(text)


def refusal(url: Column, allow_http: bool = False) -> Column:
    """Why a URL may not be fetched from outside; null if it may."""
    u = F.lower(F.trim(url))
    authority = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    scheme = F.regexp_extract(u, r"^([a-z][a-z0-9+.-]*)://", 1)
    host = F.regexp_replace(F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1), r"(.)\.$", "$1")
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    own = address(host)
    schemes = ["https", "http"] if allow_http else ["https"]
    named = "Only https:// and http:// URLs can be fetched." if allow_http else "Only https:// URLs can be fetched."
    return (
        F.when((scheme == "") | (host == ""), "That does not look like a valid URL.").when(~scheme.isin(schemes), named)
        .when((port != "") & (port != F.when(scheme == "https", "443").otherwise("80")), F.concat(F.lit("Non-standard ports cannot be fetched ("), scheme, F.lit(":// on "), F.when(scheme == "https", "443").otherwise("80"), F.lit(" only).")))
        .when(authority.contains("@"), "URLs with embedded credentials cannot be fetched.")
        .when((host == "localhost") | host.endswith(".localhost"), "localhost cannot be fetched.")
        .when(own["family"] == 6, "IPv6 literal addresses cannot be fetched — use a hostname.")
        .when(own["reserved"], F.concat(F.lit("Private or reserved IP addresses cannot be fetched ("), own["label"], F.lit(").")))
        .when(own.isNull() & (host.endswith(INTERNAL[0]) | host.endswith(INTERNAL[1]) | host.endswith(INTERNAL[2])), "Internal hostnames (.local, .internal, .localhost) cannot be fetched.")
        .when(own.isNull() & ~host.contains("."), "Single-label hostnames cannot be fetched — they resolve on the local network.")
    )
