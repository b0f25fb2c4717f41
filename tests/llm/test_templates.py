"""Recurring lines against SQL and by hand."""

import pytest

from compare import differences, oracle
from pilotlab.llm import queries, templates


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    query, sql = queries.QUERIES["op2_line_templates"]
    path = f"/root/testdata/sf{sf}"
    assert differences(query(spark, path).toPandas(), oracle(sql, path)) is None


def texts(spark, rows):
    docs = spark.createDataFrame([(k, t, 7, "p") for k, t in rows], "doc_id long, text string, n_lines int, place string")
    found = templates.drop_recurring(docs.repartition(3)).collect()
    assert all(r["place"] == "p" for r in found)
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found), key=str)


def test_by_hand(spark):
    line = "order 17 was sent to the north store"
    alike = "order 99  was\tsent to the north store"
    rows = [
        (5, f"own words of the fifth text here\n{alike}\nshort line"), (3, f"{line}\n{line}\nmore"), (None, None),
        (7, ""), (8, f"{line}"), (8, f"{line}"), (9, "short line\n\n"), (10, "1 2 3 4 5 6 7 a b\nx"), (11, "1 2 3 4 5 6 7 a b\nx"),
    ]
    assert texts(spark, rows) == sorted([
        (5, "own words of the fifth text here\nshort line", 3, 1), (3, f"{line}\n{line}\nmore", 3, 0),
        (None, None, 0, 0), (7, "", 1, 0), (8, "", 1, 1), (8, "", 1, 1), (9, "short line\n\n", 3, 0),
        (10, "1 2 3 4 5 6 7 a b\nx", 2, 0), (11, "1 2 3 4 5 6 7 a b\nx", 2, 0),
    ], key=str)
    assert texts(spark, []) == []


def test_a_field_with_many_values_is_a_wildcard(spark):
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(templates.MAX_CHILDREN + 6)]
    rows = [(i, f"dear reader we thank {n} for this kind letter") for i, n in enumerate(names)]
    found = texts(spark, rows)
    assert sorted(t for _, t, *_ in found) == [""] * (len(names) - 1) + [rows[0][1]]
    few = texts(spark, rows[: templates.MAX_CHILDREN])
    assert all(t for _, t, *_ in few)


def test_long_text_and_hot_line(spark):
    hot = "this very line stands in every second document"
    rows = [(i, f"{hot}\nline {chr(97 + i % 26)} of text {'x' * (i % 9)} that is its own {'y' * (i // 9)}") for i in range(300)]
    rows.append((300, "\n".join(f"{'z' * (i % 60)} long text with its own line {'q' * (i // 60)}" for i in range(3000))))
    found = {k: (t, d) for k, t, _, d in texts(spark, rows)}
    assert found[0][0].startswith(hot) and sum(hot in t for t, _ in found.values()) == 1
    assert found[300][1] == 0
