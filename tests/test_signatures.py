import hashlib
import hmac

from pyspark.sql import functions as F

from pagelens.functions import signatures as s

# Test vectors of RFC 8032, 7.1: public key, message, signature.
VECTORS = [
    ("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ("fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
]


def test_curve():
    for key, message, signature in VECTORS:
        key, message, signature = map(bytes.fromhex, (key, message, signature))
        assert s.ed25519_verifies(key, message, signature)
        assert not s.ed25519_verifies(key, message + b"x", signature)
        assert not s.ed25519_verifies(key, message, signature[:-1] + bytes([signature[-1] ^ 1]))
        large = (int.from_bytes(signature[32:], "little") + s._L).to_bytes(32, "little")
        assert not s.ed25519_verifies(key, message, signature[:32] + large)
    assert not s.ed25519_verifies(b"\xff" * 32, b"", bytes(64)) and not s.ed25519_verifies(b"", b"", b"")


def test_keyed_hash(spark):
    texts = ["", "a", "é" * 100, "x" * 1000]
    for secret in ("", "key", "k" * 64, "é" * 60):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", s.hmac_sha256(F.col("t"), secret).alias("h")).collect()
        assert all(r.h == hmac.new(secret.encode(), r.t.encode(), hashlib.sha256).hexdigest() for r in rows)


def test_structured_fields(spark):
    cases = {
        ('a=("x" "y\\"z");n=1;f;s="q;,", b=()', "b=:AA==:, a=:BB==:"): ("a", '("x" "y\\"z");n=1;f;s="q;,"', ["x", 'y"z'], "BB=="), ('a=("x"), ', "a=:Z:"): ("a", '("x")', ["x"], "Z"), ('a=("x")', "b=:Z:"): None, ('a=("x"', "a=:Z:"): None,
        ('a=("x";k)', "a=:Z:"): None, ("", ""): None, ('a=("X")', "a=:1:, a=:2:"): ("a", '("X")', ["x"], "2"), ('a=("x");', "a=:Z:"): None, ("a=x", "a=:Z:"): None,
    }
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, v string, g string").select("i", s.signature_input(F.col("v"), F.col("g")).alias("m")).collect()
    assert [r.m and (r.m.label, r.m.raw, r.m.components, r.m.signature) for r in sorted(rows)] == list(cases.values())


def test_proxy_rows_without_a_query(spark):
    rows = spark.createDataFrame([("https://x.example/",), (None,), ("https://x.example/?signature=",), ("?signature=zz&a",)], "u string").select(s.proxy_signed(F.col("u"), "k").alias("ok")).collect()
    assert [r.ok for r in rows] == [False] * 4
    times = spark.createDataFrame([(x,) for x in ("905", "904", "1005", "1006", "x", None, "9" * 30)], "t string").select(s.is_fresh(F.col("t"), F.lit(1000)).alias("f")).collect()
    assert [r.f for r in times] == [True, False, True, False, False, False, False]


def test_a_known_key_takes_few_sums_and_a_repeated_signature_none(monkeypatch):
    key, _, signature = (bytes.fromhex(x) for x in VECTORS[0])
    s.ed25519_verifies(key, b"first", signature)
    sums, add = [], s._add
    monkeypatch.setattr(s, "_add", lambda p, q: sums.append(1) or add(p, q))
    assert not s.ed25519_verifies(key, b"second", signature)
    assert 0 < len(sums) < 150
    done = len(sums)
    assert not s.ed25519_verifies(key, b"second", signature) and len(sums) == done


def test_products_by_tables():
    p = s._point(s._BASE)
    for n in (0, 1, 15, 16, 17, 2**252 + 12345, s._L - 1):
        want, q, m = (0, 1, 1, 0), p, n
        while m:
            want, q, m = s._add(want, q) if m & 1 else want, s._add(q, q), m >> 1
        got = s._product(n, s._BASE)
        assert (got[0] * want[2] - want[0] * got[2]) % s._P == (got[1] * want[2] - want[1] * got[2]) % s._P == 0
