import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelens.llm import periodic_runs as p
from tests.llm.common import LONG, TEXTS, documents, empty


def brute(words, least=6, exponent=4):
    out = []
    for q in range(1, len(words) // exponent + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(least, exponent * q) and not any(all(words[x] == words[x - r] for x in range(start + r, j)) for r in range(1, q)):
                out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def check(words):
    runs, collapsed = next(p.text_runs([" ".join(words)]))
    assert runs == brute(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    assert collapsed.decode() == " ".join(x for i, x in enumerate(words) if i not in dropped)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=5), st.integers(1, 7)), max_size=5))
def test_runs_equal_brute_force(blocks):
    check([x for block, times in blocks for x in block * times])


def test_few_symbols_and_long_periods():
    rng = random.Random(5)
    for symbols in (1, 2, 3, 30, 2000):
        for _ in range(60):
            words = [f"w{rng.randrange(symbols)}" for _ in range(rng.randrange(60))]
            block = [f"w{rng.randrange(symbols)}" for _ in range(rng.randrange(1, 40))]
            at = rng.randrange(len(words) + 1)
            check(words[:at] + (block * 9)[: rng.randrange(len(block), 8 * len(block) + 1)] + words[at:])


def test_texts_of_a_batch_do_not_meet():
    assert [r for r, _ in p.text_runs(["x a a a", "a a a", None, "", "b a a a a a a"])] == [[], [], [], [], [(1, 6, 1)]]


def test_only_six_characters_part_words():
    assert next(p.text_runs(["a\x0ba\ta\r\na\fa  a"]))[0] == [(0, 6, 1)]
    assert next(p.text_runs(["a a\x1ca\x85a a a"]))[0] == []


def test_awkward_rows(spark):
    rows = p.find_runs(documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    by = {(r.doc_id, r.collapsed[:9]): r for r in rows}
    assert [tuple(x) for x in by[5, LONG[:9]].runs] == [(0, 36000, 6)] and by[5, LONG[:9]].collapsed == LONG[:38]
    assert by[3, ""].runs == [] and by[2, ""].runs == [] and (None, "") in by and (None, "a text wi") in by
    assert p.find_runs(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        p.find_runs(documents(spark), exponent=2)


def test_other_columns_of_other_types(spark):
    docs = spark.createDataFrame([("k", "a b a b a b a b a b", 1)], "`i.d` string, runs string, collapsed int")
    r = p.find_runs(docs, "i.d", "runs", least=8).first()
    assert (r[0], [tuple(x) for x in r.runs], r.collapsed) == ("k", [(0, 10, 2)], "a b")
