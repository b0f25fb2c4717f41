"""Licence scan against SQL and by hand."""

import pytest

from compare import differences, oracle
from pilotlab.llm import licences, queries


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    query, sql = queries.QUERIES["op1_licence_scan"]
    path = f"/root/testdata/sf{sf}"
    found = query(spark, path).toPandas()
    assert differences(found, oracle(sql, path)) is None
    assert found["licence"].notna().sum() > 0


def test_anchors_lose_nothing():
    """A text of all the other terms of a notice stays below the threshold."""
    found = set(licences.anchors(licences.NOTICES, licences.THRESHOLD))
    for i in range(len(licences.NOTICES)):
        rest = [w for n, _, t, w in licences.weights(licences.NOTICES) if n == i and t not in found]
        assert 1000 * sum(w * w for w in rest) ** 0.5 < licences.THRESHOLD


def test_by_hand(spark):
    mit, cc = "Released under the MIT License.", "Licensed under CC BY-NC 4.0."
    rows = [
        ("LICENSE", mit), ("a/b/LICENSE.txt", f"some words first\n{cc}\nand more"), ("a/b/LICENSE.txt", f"some words first\n{cc}\nand more"),
        ("a/x.py", "code"), ("a/b/c/y.py", "code"), ("a/b/c/z.py", f"# {mit}\ncode"), ("a/bb/z.py", None), (None, mit), (None, None),
        ("top.py", ""), ("a/b/w.py", "x " * 100_000 + "\n" + cc), ("q/COPYING", "nothing known"), ("q/r.py", "this license is strange"),
    ]
    table = spark.createDataFrame([(p, t, 1, 0.5) for p, t in rows], "path string, text string, score int, licence double")
    found = sorted(((r["path"], r["licence"], r["licence_from"], r["score"]) for r in licences.scan(table).collect()), key=str)
    expected = [
        ("LICENSE", "MIT", "LICENSE"), *[("a/b/LICENSE.txt", "CC-BY-NC-4.0", "a/b/LICENSE.txt")] * 2, ("a/x.py", "MIT", ""),
        ("a/b/c/y.py", "CC-BY-NC-4.0", "a/b"), ("a/b/c/z.py", "MIT", "a/b/c/z.py"), ("a/bb/z.py", "MIT", ""),
        (None, "MIT", None), (None, None, None), ("top.py", "MIT", ""), ("a/b/w.py", "CC-BY-NC-4.0", "a/b/w.py"),
        ("q/COPYING", "MIT", ""), ("q/r.py", "MIT", ""),
    ]
    assert found == sorted(((*e, 1) for e in expected), key=str)
    assert licences.scan(table.limit(0)).collect() == []
