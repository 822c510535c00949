"""Rendered documents as Column expressions: byte budgets, front matter, canonical JSON and hashes."""

from __future__ import annotations

import json
from decimal import Decimal
from math import isinf

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_BYTES, FRONT_MATTER_BYTES = 5120, 2048
NOTE = "*Truncated to fit size budget; remaining content omitted.*"
# Headers that change from answer to answer.
VOLATILE = ["date", "age", "set-cookie", "x-request-id", "cf-ray", "report-to"]


def within_budget(required: Column, sections: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Required blocks, then sections (ARRAY<STRUCT<heading, items>>) while they fit, items from the last one cut off, with a note if any is.

    One fold over all items in order: each carries what precedes it, so a section
    begins only with its first item that fits, and nothing follows a cut.
    """
    head = F.array_join(required, "\n\n")
    whole = F.concat(head, F.array_join(F.transform(sections, lambda s: F.concat(F.lit("\n\n"), s["heading"], F.lit("\n\n"), F.array_join(s["items"], "\n"))), ""))
    pieces = F.flatten(F.transform(sections, lambda s: F.transform(s["items"], lambda item, i: F.when(i == 0, F.concat(F.lit("\n\n"), s["heading"], F.lit("\n\n"), item)).otherwise(F.concat(F.lit("\n"), item)))))
    room = max_bytes - len(f"\n\n{NOTE}".encode())
    start = F.struct(head.alias("text"), F.lit(True).alias("open"))

    def step(s: Column, piece: Column) -> Column:
        fits = s["open"] & (F.octet_length(s["text"]) + F.octet_length(piece) <= room)
        return F.struct(F.when(fits, F.concat(s["text"], piece)).otherwise(s["text"]).alias("text"), fits.alias("open"))

    cut = F.aggregate(pieces, start, step, lambda s: F.concat(s["text"], F.lit(f"\n\n{NOTE}")))
    return F.when(F.octet_length(whole) <= max_bytes, whole).otherwise(cut)


def yaml_scalar(value: Column) -> Column:
    """A text as it is where YAML reads it as that text, else in double quotes."""
    plain = (
        value.rlike(r"^[\p{L}\p{N}]") & ~value.rlike(r"^\s|\s$|[\x{00}-\x{1f}\x{7f}-\x{9f}\x{2028}\x{2029}\x{feff}]|: | #|:$")
        & ~value.rlike(r"(?i)^(true|false|yes|no|on|off|y|n|null|~)$") & ~value.rlike(r"^[0-9][0-9a-fA-FxXoO_.:+-]*$") & ~value.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}")
    )
    wrapped = F.to_json(F.array(value))
    quoted = F.replace(F.replace(F.substr(wrapped, F.lit(2), F.length(wrapped) - 2), F.lit(" "), F.lit("\\u2028")), F.lit(" "), F.lit("\\u2029"))
    return F.when(plain, value).otherwise(quoted)


def front_matter(title: Column, description: Column, url: Column, updated: Column) -> Column:
    """A YAML block of the fields that are not blank; without the description if it is too long, and empty if it still is."""
    own = lambda v: F.when(F.trim(v) != "", v)
    line = lambda key, v: F.when(v.isNotNull(), F.concat(F.lit(f"{key}: "), yaml_scalar(v)))
    rest = [line("canonical_url", F.when(F.lower(url).rlike("^https?://[^/?#]"), url)), line("last_updated", own(updated))]

    def block(lines: list[Column]) -> Column:
        kept = F.array_compact(F.array(*lines))
        return F.when(F.size(kept) == 0, "").otherwise(F.concat(F.lit("---\n"), F.array_join(kept, "\n"), F.lit("\n---\n")))

    full, short = block([line("title", own(title)), line("description", own(description)), *rest]), block([line("title", own(title)), *rest])
    return F.when(F.octet_length(full) <= FRONT_MATTER_BYTES, full).when(F.octet_length(short) <= FRONT_MATTER_BYTES, short).otherwise("")


def number(value: float) -> str:
    """A number as JSON writers of web pages write it: the shortest digits, plain from 1e-6 up to below 1e21."""
    if isinstance(value, int) and abs(value) > 2**53:
        value = float(value)
    if value == 0 or isinf(value):
        return "null" if value else "0"
    sign, digits, point = Decimal(repr(value)).normalize().as_tuple()
    text, n = "".join(map(str, digits)), len(digits) + point  # 0.text times ten to the n
    if 0 < n <= 21:
        plain = text.ljust(n, "0")[:n] + ("." + text[n:] if len(text) > n else "")
    elif -6 < n <= 0:
        plain = "0." + "0" * -n + text
    else:
        plain = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{n - 1:+d}"
    return "-" * sign + plain


def canonical(value) -> str:
    """A JSON value without spaces, keys in the order of their UTF-16 units."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return number(value)
    return json.dumps(value, ensure_ascii=False)


def _no_number(name: str):
    raise ValueError(name)


@F.udf(StringType(), useArrow=True)
def canonical_json(value: str | None) -> str | None:
    """A JSON text in canonical form; null if it does not parse. A number beyond the range of doubles is null."""
    try:
        return None if value is None else canonical(json.loads(value, parse_constant=_no_number))
    except (ValueError, OverflowError, RecursionError):
        return None


def canonical_hash(value: Column) -> Column:
    return F.sha2(canonical_json(value), 256)


def stable_headers(headers: Column) -> Column:
    """Headers by lower-case name, without those that change from answer to answer."""
    named = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.filter(named, lambda e: ~e["key"].isin(VOLATILE)))


@F.udf(StringType(), useArrow=True)
def etag(body: str | None) -> str | None:
    """A weak entity tag: 64-bit FNV-1a over UTF-16 units, and their count, in hexadecimal digits."""
    if body is None:
        return None
    raw = body.encode("utf-16-le", "surrogatepass")
    h = 0xCBF29CE484222325
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x100000001B3) & (2**64 - 1)
    return f'W/"{h:x}-{len(raw) // 2:x}"'
