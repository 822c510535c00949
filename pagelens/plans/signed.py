"""Queries about signed requests: message signatures of agents and keyed hashes of proxied requests, made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import signatures
from pagelens.plans.literal import table, values
from pagelens.sources.shared import dealt, read_table

# A key of a test, and its signature of a request for https://shop.example/a.
_PUBLIC = "4h6wO37klFr0br14Qud_1JQY0584oNEYoKkgopghXgQ"
_SIGNATURE = "jO/0x2zQjqPMQICx2PzG0hlfiA+/tBqfca4RRMiHWqk9WsgnJMJsNsN6ofujveYY26B9E/QagWABGxAu9Ru9Cw=="
_INPUT = '("@authority" "signature-agent" "@path");created=1704067200;expires=1706745600;keyid="k1";alg="ed25519"'
KEYS = [("https://agent.example", "k1", "ed25519", _PUBLIC), ("https://agent.example", "k2", "rsa-pss-sha512", _PUBLIC), ("https://other.example", "k1", "ed25519", _PUBLIC[:-2] + "AA")]
_GOOD = {"signature": f"sig1=:{_SIGNATURE}:", "signature-input": f"sig1={_INPUT}", "signature-agent": '"https://agent.example"', "path": "/a"}


def _with(before: str, after: str) -> dict[str, str]:
    return {"signature-input": "sig1=" + _INPUT.replace(before, after)}


# Requests by the remainder of an event's key: what differs from one that is signed well, and what is found: whether it is verified, the key, the reason.
CASES = [
    ({}, True, "k1", None), ({"signature": None}, False, None, "no-signature"), (_with('"@path")', '"@path"'), False, None, "malformed"), (_with(' "signature-agent"', ""), False, None, "malformed"), (_with("ed25519", "rsa"), False, None, "unsupported-alg"),
    ({"signature-agent": "new.example"}, False, "k1", "unknown-agent"), (_with('"k1"', '"k9"'), False, "k9", "unknown-key"), (_with("1704067200;expires=1706745600", "1600000000;expires=1600000100"), False, "k1", "expired"),
    (_with("1704067200;expires=1706745600", "2000000000;expires=2000000100"), False, "k1", "created-in-future"), ({"path": "/b"}, False, "k1", "bad-signature"), ({"signature": "sig1=:*:"}, False, "k1", "malformed"), (_with('"k1"', '"k2"'), False, "k2", "unsupported-alg"),
    (_with("1706745600", "1700000000"), False, "k1", "malformed"), ({"signature-input": f'sig0=("@authority");created=1, sig1={_INPUT}', "signature": f"sig1=:{_SIGNATURE}:;x=1, sig2=:AA==:"}, True, "k1", None), ({"signature-agent": "https://OTHER.example:443/x"}, False, "k1", "bad-signature"),
    (_with(';keyid="k1"', ""), False, None, "malformed"), (_with('"@path"', '"@path" "x-none"'), False, "k1", "malformed"),
]


def agent_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether requests made of events carry an agent's valid signature at the time of the event, and if not, why."""
    forms = [_GOOD | change for change, *_ in CASES]
    each = F.element_at(F.array(*[F.struct(*[F.lit(f[k]).cast("string").alias(k) for k in _GOOD]) for f in forms]), (F.col("event_id") % len(forms) + 1).cast("int"))
    rows = dealt(read_table(spark, sf_dir, "events").select("event_id", "ts"), "event_id").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), each.alias("f"))
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.array(F.col("f").getField(k)).alias("value")) for k in _GOOD if k != "path"]), lambda e: e["value"][0].isNotNull())
    requests = rows.select(F.struct("event_id", "at").alias("request"), F.map_from_entries(entries).alias("headers"), F.lit("GET").alias("method"), F.concat(F.lit("https://Shop.example:443"), F.col("f.path"), F.lit("?q")).alias("url"))
    found = signatures.verify_agents(requests, table(spark, "origin string, keyid string, alg string, x string", KEYS), F.col("request.at"))
    return found.select("request.event_id", "verified", "keyid", "reason")


SECRET = "hush"


def proxy_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proxied requests made of events: the hash of their parameters, whether it is the one they carry, and whether they are recent."""
    e = F.col("event_id").cast("string")
    covered = F.concat(F.lit("ids=1,"), e, F.lit("path=/x yshop=é.example"), F.lit("timestamp="), e)
    own = signatures.hmac_sha256(covered, SECRET)
    given = F.when(F.col("event_id") % 3 == 0, F.upper(own)).when(F.col("event_id") % 3 == 1, own).otherwise(F.translate(own, "01", "10"))
    url = F.concat(F.lit("https://shop.example/apps/x?shop=%C3%A9.example&ids=1&signature="), given, F.lit("&timestamp="), e, F.lit("&path=%2Fx+y&ids="), e, F.lit("#top"))
    rows = read_table(spark, sf_dir, "events").select("event_id", url.alias("url"))
    pairs = signatures.parameters(F.col("url"))
    return rows.select("event_id", signatures.hmac_sha256(signatures.proxy_message(pairs), SECRET).alias("hmac"), signatures.proxy_signed(F.col("url"), SECRET).alias("signed"), signatures.is_fresh(F.col("event_id").cast("string"), F.lit(1000)).alias("fresh"))


def _pad(byte: int) -> str:
    key = SECRET.encode().ljust(64, b"\0")
    return "'" + "".join(f"\\x{x ^ byte:02X}" for x in key) + "'::BLOB"


_DIGEST = f"sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode('ids=1,' || event_id || 'path=/x yshop=é.example' || 'timestamp=' || event_id))))"
QUERIES = {
    "agent_signatures": (
        agent_signatures,
        f"WITH {values('found', 't, verified, keyid, reason', [(i, *x[1:]) for i, x in enumerate(CASES)])} SELECT event_id, verified, keyid, reason FROM events JOIN found ON event_id % {len(CASES)} = t",
    ),
    "proxy_signatures": (proxy_signatures, f"WITH d AS (SELECT event_id, {_DIGEST} AS hmac FROM events) SELECT event_id, hmac, event_id % 3 < 2 OR translate(hmac, '01', '10') = hmac AS signed, event_id BETWEEN 905 AND 1005 AS fresh FROM d"),
}
