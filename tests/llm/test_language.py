"""Language identification against plain subwords, held-out rows and a hand-made calibration."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pilotlab.llm import language, queries
from pilotlab.llm.hashing import text_bytes

SF = "/root/testdata/sf0.01"
ODD = [None, "", "  \n", "12 34 !? \U0001f642", "x", "É", "a1b", "The the", "the THE", "z" * 300_000, "der und " * 50_000, "日本語の文章"]


def plain_subwords(text):
    """The same subwords as byte strings, the edge as a zero byte."""
    folded = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 0 for b in text.encode())
    out = []
    for word in folded.split(b"\0"):
        whole = b"\0" + word + b"\0"
        out += [whole[i : i + n] for n in language.ORDERS for i in range(len(whole) - n + 1)] if word else []
    return out


def test_subwords(monkeypatch):
    monkeypatch.setattr(language, "STEP", 7)
    texts = ["", "ab c", " ", "", "é 1x", "q", "abcdefgh " * 3, "\n"]
    data, offsets = text_bytes(pa.array(texts))
    found = [np.zeros(0, np.int64)] * len(texts)
    for buckets, bounds in language.subwords(data, offsets, 20):
        for i in range(len(texts)):
            found[i] = np.append(found[i], buckets[bounds[i] : bounds[i + 1]])
    for text, own in zip(texts, found):
        expected = plain_subwords(text)
        assert len(own) == len(expected)
    # Equal subwords have equal buckets: the counts of buckets equal the counts of subwords.
    for text, own in zip(texts, found):
        counts = sorted(np.unique(own, return_counts=True)[1].tolist())
        values: dict = {}
        for s in plain_subwords(text):
            values[s] = values.get(s, 0) + 1
        assert counts == sorted(values.values())


def test_calibration_is_the_nearest_rising_function():
    rng = np.random.default_rng(2)
    bins = {int(b): (int(n), int(rng.integers(0, n + 1))) for b, n in zip(rng.permutation(60)[:25], rng.integers(1, 9, 25))}
    steps = language.calibrated(bins)
    assert [s for _, s in steps] == sorted({s for _, s in steps})
    # The known min-max form of the least-squares rising function.
    keys = sorted(bins)
    for i, b in enumerate(keys):
        share = lambda x, y: sum(bins[k][1] for k in keys[x : y + 1]) / sum(bins[k][0] for k in keys[x : y + 1])
        expected = max(min(share(x, y) for y in range(i, len(keys))) for x in range(i + 1))
        assert [s for first, s in steps if first <= b][-1] == pytest.approx(expected)
    assert language.calibrated({}) == []


def test_held_out_accuracy(spark):
    found = {r["doc_id"]: r for r in queries.QUERIES["op13_subword_language"][0](spark, SF).collect()}
    given = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert found.keys() == {r["doc_id"] for r in given}
    held = [r for r in given if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(found[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in given)
    assert np.mean([found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) >= 0.97
    accepted = [r for r in held if found[r["doc_id"]]["accepted"]]
    assert len(accepted) > 0.9 * len(held)
    assert np.mean([found[r["doc_id"]]["lang_pred"] == r["lang"] for r in accepted]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    words = {"xx": ["kala", "mato", "pilu"], "yy": ["straw", "think", "grump"], "zz": ["éàü", "öç", "ñandú"]}
    rows = [(i, " ".join(rng.choice(words[k], 30)), k, 1.0, "q") for i, k in enumerate(list(words) * 60)]
    rows += [(1000 + i, t, None, 2.0, "q") for i, t in enumerate(ODD)] + [(None, "kala kala", None, 0.0, ""), (7, "think", "yy", 0.0, "")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, _raw double, key string").repartition(4)


def test_odd_rows(docs):
    part = F.col("doc_id") % 5
    rows = language.identify(docs, part != 0, part == 1).collect()
    assert len(rows) == docs.count()
    found = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(ODD):
        letters = any(c.isalpha() for c in t or "")
        assert (found[1000 + i]["lang_pred"] != "und") == letters
        assert letters or (found[1000 + i]["score"], found[1000 + i]["accepted"]) == (0.0, False)
    assert found[None]["lang_pred"] == "xx"
    held = [found[i] for i in range(0, 180, 5)]
    assert all(r["lang_pred"] == ["xx", "yy", "zz"][r["doc_id"] % 3] and r["accepted"] for r in held)
    again = language.identify(docs.repartition(1), part != 0, part == 1).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_labels_and_keys_do_not_enter_predictions(docs):
    model = language.fit(docs, F.col("doc_id") % 5 != 0)
    texts = docs.select("text", "lang", "doc_id")
    one = language.score(texts, model).select("_best", "_raw")
    other = language.score(texts.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.lit(1)), model).select("_best", "_raw")
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_many_languages_and_nothing_to_learn(spark, docs):
    rows = [(i, f"w{chr(97 + i % 20)} {chr(97 + i % 20) * 3}", f"l{i % 20:02d}") for i in range(400)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(many, F.lit(True), F.col("doc_id") % 7 == 0, language.Training(dimensions=8)).collect()
    assert np.mean([r["lang_pred"] == f"l{r['doc_id'] % 20:02d}" for r in found]) > 0.95
    none = language.identify(docs, F.lit(False), F.lit(True)).collect()
    assert {(r["lang_pred"], r["score"], r["accepted"]) for r in none} == {("und", 0.0, False)}
    one = language.identify(docs.where("lang = 'xx'"), F.lit(True), F.lit(None).cast("boolean")).collect()
    assert {r["lang_pred"] for r in one} == {"xx"}
    assert language.identify(docs.limit(0), F.lit(True), F.lit(False)).collect() == []
