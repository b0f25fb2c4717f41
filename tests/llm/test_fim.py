"""Fill-in-middle against plain Python and against SQL."""

import hashlib
import re

import numpy as np
import pytest

from compare import differences, oracle
from pilotlab.llm import fim, queries

ODD = [
    None, "", "\n", "\n\n\n", "one line", "one\n", "a\nb", "é\nüß\n\U0001f642\nx", "a <P> b\nc", "a <S>\nb", "<M>", "<\nP>\n<",
    "x<P\n>y<\n", "same\ntext\n", "same\ntext\n", "\r\n\x0b \u0085\n", "long " * 20_000 + "\n" + "w\n" * 70_000 + "end", "\x8a\n\x0b\x09\n" * 9,
]


def plain(key, text, choice=fim.Choice()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{choice.seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= choice.percent:
        return (key, len(units), "plain", None, None, text)
    spm = h[3] % 100 < choice.suffix_first
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (key, len(units), "spm" if spm else "psm", len(prefix), len(middle), out)


@pytest.fixture(scope="module")
def docs(spark):
    """Every text under ten keys, one row twice, a null key, and columns with clashing names."""
    rows = [(None if i == 44 else i, ODD[i % len(ODD)], 1, "x", 2) for i in range(10 * len(ODD))]
    rows.append(rows[7])
    return spark.createDataFrame(rows, "doc_id long, text string, n int, form string, key int").repartition(3)


@pytest.mark.parametrize("choice", [fim.Choice(), fim.Choice(3, 60, 20), fim.Choice(1, 0, 50)])
def test_against_plain_python(docs, choice):
    given = docs.select("doc_id", "text").collect()
    found = fim.transform(docs, choice).withColumn("back", fim.restored()).collect()
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r)[:-1] for r in found) == order(plain(r[0], r[1], choice) for r in given)
    assert sorted(r["back"] for r in found) == sorted(r["text"] or "" for r in given)


def test_rank_and_select():
    """Against plain counting, over bytes of every value in runs of every length."""
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 64, 1000):
        data = rng.integers(0, 256, n).astype(np.uint8)
        data[rng.random(n) < 0.3] = 10
        marks = fim.Marks(fim.equal_marks(fim.words_of(data), 10))
        places = np.flatnonzero(data == 10)
        assert marks.rank(np.arange(n + 1)).tolist() == np.concatenate([[0], np.cumsum(data == 10)]).tolist()
        assert marks.select(np.arange(1, len(places) + 1)).tolist() == places.tolist()
        following = fim.Marks(fim.following_marks(fim.words_of(data)))
        assert following.rank(np.array([n]))[0] == ((data & 0xC0) == 0x80).sum()


def test_empty_table(docs):
    assert fim.transform(docs.limit(0)).collect() == []


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    query, sql = queries.QUERIES["op12_swar_fim"]
    path = f"/root/testdata/sf{sf}"
    assert differences(query(spark, path).toPandas(), oracle(sql, path)) is None
