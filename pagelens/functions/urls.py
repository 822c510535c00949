"""URL parts as Column expressions, for absolute URLs with an authority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ABSOLUTE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"


def is_absolute(url: Column) -> Column:
    return url.rlike(_ABSOLUTE)


def host(url: Column) -> Column:
    """Lower-case host without user or port; null unless absolute."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(found, F.lit(""))


def origin(url: Column) -> Column:
    """Scheme and authority of an absolute URL in lower case, without the scheme's own port; null unless absolute."""
    found = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://)(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://)(?:[^/?#@]*@)?([^/?#]*)", 2))
    return F.when(is_absolute(url), F.regexp_replace(F.concat(*found), r"^(https://[^/]*?):443$|^(http://[^/]*?):80$", "$1$2"))


def path(url: Column) -> Column:
    """Path of an absolute URL ("/" if empty), else the text before the first # or ?."""
    own = F.regexp_extract(url, _ABSOLUTE + r"[^/?#]*([^?#]*)", 1)
    return F.when(is_absolute(url), F.coalesce(F.nullif(own, F.lit("")), F.lit("/"))).otherwise(F.regexp_extract(url, r"^([^?#]*)", 1))


def query_value(url: Column, name: str) -> Column:
    """Decoded first value of a query parameter; null if it is absent or not decodable."""
    raw = F.regexp_extract(F.regexp_extract(url, r"\?([^#]*)", 1), rf"(?:^|&){name}=([^&]*)", 1)
    present = F.regexp_extract(url, r"\?([^#]*)", 1).rlike(rf"(?:^|&){name}=")
    return F.when(present, F.try_url_decode(raw))


def has_suffix(name: Column, domain: str) -> Column:
    """The domain itself or a host below it."""
    return (name == domain) | name.endswith(f".{domain}")


def by_domain(name: Column, table: list[tuple[str, str]]) -> Column:
    """Value of the first domain of an ordered table that holds a host; null if none does."""
    return F.coalesce(*[F.when(has_suffix(name, d), F.lit(v)) for d, v in table])


# Query parameters that an event's URL may keep.
KEPT_PARAMS = ["page", "variant", "sku", "lang", "locale", "currency"]


def sanitized(url: Column) -> Column:
    """A URL without its fragment, and with no query parameters but the kept ones, by name; one that is not absolute is cut at its first ? or #."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p, i: F.struct(F.lower(decoded(F.regexp_extract(p, "^([^=]*)", 1))).alias("name"), i.alias("at"), decoded(F.regexp_extract(p, "=(.*)$", 1)).alias("value")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: p["name"].isin(KEPT_PARAMS)))
    text = F.array_join(F.transform(kept, lambda p: F.concat(p["name"], F.lit("="), F.url_encode(p["value"]))), "&")
    origin = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://)", 1))
    authority = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, _ABSOLUTE + r"(?:[^/?#@]*@)?([^/?#]*)", 1)), r"^(.*):443$", F.when(origin == "https://", "$1").otherwise("$1:443")), r"^(.*):80$", F.when(origin == "http://", "$1").otherwise("$1:80"))
    whole = F.concat(origin, authority, path(url), F.when(text == "", "").otherwise(F.concat(F.lit("?"), text)))
    return F.when(~url.rlike("[?#]"), url).when(is_absolute(url), whole).otherwise(F.regexp_extract(url, r"^([^?#]*)", 1))
