"""Rows that every operator on texts must take: nulls, empty and long texts, repeated rows, clashing column names."""

LONG = ("lorem ipsum dolor sit amet consectetur " * 6000).strip()
TEXTS = [
    (1, "the cat sat on the mat by the door of the house"), (2, None), (None, "a text without an id"), (3, ""), (4, "   "), (5, LONG),
    (1, "the cat sat on the mat by the door of the house"), (6, "é 日本語 👩‍👩‍👧  x\ty\r\nz\0\x01"), (7, "one"), (7, "two other words"), (None, None),
]
CLASHING = "row string, part int, uid string, ids string, key string, fp string, block string, label string, features string, u int, n int"


def documents(spark, rows=TEXTS):
    extra = ("r", 1, "u", "i", "k", "f", "b", "l", "x", 2, 3)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {CLASHING}")


def empty(spark):
    return documents(spark, [])
