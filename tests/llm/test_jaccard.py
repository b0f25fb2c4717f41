"""The n-gram Jaccard join and its parts against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from compare import differences, oracle
from pilotlab.llm import jaccard, queries
from pilotlab.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def classes(rows):
    """(key, text) rows to sorted (key, n, component)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_shingle: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            by_shingle.setdefault(g, []).append(i)
    pairs = {p for ids in by_shingle.values() for p in combinations(ids, 2)}
    for i, j in pairs:
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    found = [(k, len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))]
    return sorted(found, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n int, node string")
    found = [tuple(r) for r in jaccard.join(docs.repartition(3)).collect()]
    assert sorted(found, key=str) == classes(rows)


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(100))
    check(spark, [
        (1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, base), (8, base.upper()),
        (8, base), (9, base + " tail"), (9, "other text of more than five words"), (None, base + " end"),
        (None, "lone text without a key here"), (12, "x " * 30_000), (13, "x x x x x x x"), (14, "a b"),
    ])
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_families(spark, monkeypatch, seed):
    """Near copies at many distances, chains of links, and a passage that all share; small chunks."""
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rng = random.Random(seed)
    passage = [rng.choice("the of and to in on is was".split()) + str(i % 7) for i in range(60)]
    rows = []
    for family in range(12):
        text = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 200]))]
        if family % 2:
            text = text[:30] + passage + text[30:]
        for _ in range(rng.choice([1, 3, 60])):
            copy = list(text)
            for _ in range(rng.randrange(0, 1 + len(copy) // 30)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                text = copy
            rows.append((len(rows), " ".join(copy)))
    check(spark, rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in jaccard.join(docs).collect()), key=str) == classes(rows)


def test_trie_matches_are_all_pairs():
    rng = np.random.default_rng(3)
    base = np.arange(40)
    sets = [np.sort(rng.choice(60, rng.integers(1, 40), replace=False)) for _ in range(60)]
    sets += [np.unique(np.where(rng.random(40) < 0.1, rng.integers(0, 60, 40), base)) for _ in range(40)]
    sizes = [len(s) for s in sets]
    trie = jaccard.Trie(sets, sizes)
    for i, s in enumerate(sets):
        inside = np.zeros(60, bool)
        inside[s] = True
        near = {
            j for j, o in trie.matches(s, sizes[i], inside, 80, lambda j: False)
            if 100 * o >= 80 * (sizes[i] + sizes[j] - o)
        }
        brute = {j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))}
        assert near == brute


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(0, i) for i in range(500, 700)]
    pairs += [(i, i + 1) for i in range(1000, 1060)]
    root = {}
    for a, b in pairs:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    expected = {(k, v) for k, v in root.items() if any(k in p and p[0] != p[1] for p in pairs)}
    found = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    query, sql = queries.QUERIES["op9_trie_jaccard"]
    path = f"/root/testdata/sf{sf}"
    assert differences(query(spark, path).toPandas(), oracle(sql, path)) is None


def test_representatives_of_a_table_with_clashing_names(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a", 5, 7), (2, text, "b", 6, 8), (3, None, "c", None, None), (2, text, "d", 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _hash int, _own_hash int")
    found = jaccard.representatives(docs)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted([rows[0], rows[2]], key=str)
