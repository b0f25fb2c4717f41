"""Backoff scores against SQL and against plain counting."""

import math
from collections import Counter

import numpy as np
import pytest

from compare import differences, oracle
from pilotlab.llm import exchange, lm, queries


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    query, sql = queries.QUERIES["op6_stupid_backoff"]
    path = f"/root/testdata/sf{sf}"
    assert differences(query(spark, path).toPandas(), oracle(sql, path)) is None


def plain(texts):
    split = [(t or "").lower().split() for t in texts]
    grams = [[Counter(zip(*[w[i:] for i in range(n)])) for n in (1, 2, 3)] for w in split]
    total = [sum((g[n] for g in grams), Counter()) for n in range(3)]
    size = sum(map(len, split))
    out = []
    for w, own in zip(split, grams):
        c = lambda *g: total[len(g) - 1][g] - own[len(g) - 1][g]
        rest, levels, score = max(1, size - len(w)), [0, 0, 0, 0], 0
        for i, x in enumerate(w):
            if i > 1 and c(w[i - 2], w[i - 1], x):
                k, s = 3, c(w[i - 2], w[i - 1], x) / c(w[i - 2], w[i - 1])
            elif i > 0 and c(w[i - 1], x):
                k, s = 2, 0.4 ** (min(i, 2) - 1) * (c(w[i - 1], x) / c(w[i - 1]))
            elif c(x):
                k, s = 1, 0.4 ** min(i, 2) * (c(x) / rest)
            else:
                k, s = 0, 0.4 ** min(i, 2) / (rest + 1)
            levels[3 - k] += 1
            score += round(1000 * math.log(s))
        out.append((len(w), *levels, score))
    return out


def check(spark, texts):
    rows = [(i, t, 3, "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, block string")
    found = lm.score(docs.repartition(2)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(i, *s) for i, s in enumerate(plain(texts))]


def test_odd_rows(spark):
    check(spark, [None, "", " \n", "a", "A b", "a b c", "a b c d", "a b c d", "the cat sat on the mat the cat sat", "cat sat on", "x " * 30_000, "b a\tx\nx x"])
    check(spark, ["only one text here"])
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_DOCS", 2)
    check(spark, [f"w{i % 3} w{i % 4} of the w{i % 5} and so on w{i}" for i in range(40)])


def test_repeated_and_null_keys(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b c")], "doc_id long, text string")
    found = sorted((tuple(r) for r in lm.score(docs).collect()), key=str)
    s = plain(["a b", "a b", "a b c"])
    assert found == sorted([(1, *s[0]), (1, *s[1]), (None, *s[2])], key=str)


def test_catalogue_is_left_clean(spark):
    before = {t.name for t in spark.catalog.listTables()}
    check(spark, ["a b c", "a b d"])
    assert {t.name for t in spark.catalog.listTables()} == before


def test_counts_of_every_width():
    for largest in (0, 255, 256, 1 << 16, 1 << 32, 1 << 40):
        values = np.array([1, 0, largest])
        packed = exchange.narrow(values)
        assert exchange.widened(packed).tolist() == values.tolist()
        assert len(packed) == 1 + 3 * packed[0]
    assert exchange.widened(exchange.narrow(np.zeros(0, np.int64))).tolist() == []
