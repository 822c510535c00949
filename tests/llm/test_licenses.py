import pytest

from pagelens.llm import licenses as l
from tests.llm.common import documents, empty

ROWS = [
    (1, "some text\nLicensed under the Apache License, Version 2.0.\n"), (2, "Released under the MIT License."), (3, "The library is open to all and free of noise."), (4, None), (5, ""), (None, "All rights reserved."),
    (6, "Licensed under CC BY-NC 4.0."), (6, "Licensed under CC BY-NC 4.0."), (7, "a b c " * 20_000 + "\nThis work is licensed under the GNU General Public License, version 3."), (8, "the work of the public version"),
]


@pytest.fixture(scope="module")
def model(spark):
    return l.fit(documents(spark, ROWS))


def test_families(spark, model):
    got = sorted((r.doc_id or 0, r.paragraph, r.family, r.confirmed) for r in l.scan(documents(spark, ROWS), model).collect())
    assert got == [(0, 0, "proprietary", True), (1, 1, "apache-2.0", True), (2, 0, "mit", True), (6, 0, "cc-by-nc", True), (6, 0, "cc-by-nc", True), (7, 1, "gpl", True)]


def test_no_python_in_the_plan(spark, model):
    plan = l.scan(documents(spark, ROWS), model)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty_table(spark, model):
    assert l.scan(empty(spark), model).count() == 0
