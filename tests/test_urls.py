from pyspark.sql import functions as F

from pagelens.functions import urls

CASES = [
    ("https://x.example/a", "https://x.example/a"), ("https://X.example:443/a?q=1&Page=2#f", "https://x.example/a?page=2"), ("http://u:p@x.example:80?sku=a+b&lang=de&q=z", "http://x.example/?lang=de&sku=a+b"),
    ("/rel?page=1#x", "/rel"), ("https://x.example/?page=%zz&variant=", "https://x.example/?page=%25zz&variant="), ("https://x.example:8443/p?ref=1", "https://x.example:8443/p"), ("#top", ""), (None, None),
]


def test_sanitized(spark):
    rows = spark.createDataFrame([(u,) for u, _ in CASES], "u string").select(urls.sanitized(F.col("u")).alias("s")).collect()
    assert [r.s for r in rows] == [w for _, w in CASES]
