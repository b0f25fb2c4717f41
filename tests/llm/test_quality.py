"""Text statistics against plain Python, decision lists on planted rules, held-out accuracy."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pilotlab.llm import queries, quality

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall(text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    ls = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text or ""), len(ls) - len(set(ls)), len(covered)


ODD = [
    None, "", " \n\n", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n\n\n y\nx",
    "é\U0001f642 #*$ %&|<>\x85b\xa0c", "w " * 20_000, " ".join(f"u{i}" for i in range(9000)) + "\n" + "q r s t " * 3000,
    " ".join(f"v{i % 90} v{i % 91} v{i % 7}" for i in range(900)),
]


def test_statistics(spark):
    rows = [(i, t, "k", 9) for i, t in enumerate(ODD)] + [(3, "a", "k", 9), (None, "a b", "k", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found, rules = quality.assess(docs.repartition(3), labels)
    found = found.collect()
    assert len(found) == len(rows) and rules.rules == []
    texts = dict(enumerate(ODD)) | {None: "a b"}
    for r in found:
        assert tuple(r[c] for c in quality.BASE) == plain(texts[r["doc_id"]])
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)
    assert quality.keep_good(docs.limit(0), labels).collect() == []
    kept = quality.keep_good(docs, labels).collect()
    assert kept and all(r["kept"] == "k" and r["n_words"] == 9 for r in kept)


def test_learned_rules_match_planted_ones(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1001)).cast("int").alias(f) for i, f in enumerate(quality.FEATURES)],
    )
    bad = ((F.col("f_symbols") >= 700) & (F.col("f_upper") <= 300)) | (F.col("f_digits") >= 900)
    labels = rows.select("doc_id", (~bad).cast("int").alias("quality"))
    labels = labels.union(labels.where("doc_id < 50")).union(spark.sql("SELECT CAST(NULL AS LONG), 0 UNION ALL SELECT 7L, NULL"))
    rules = quality.fit(quality.labelled(rows, labels))
    wrong = rows.where(rules.keeps() == bad).count()
    assert 2 <= len(rules.rules) <= 4 and wrong <= 20
    one_class = quality.labelled(rows, labels.withColumn("quality", F.lit(1)))
    assert quality.fit(one_class).rules == []


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.QUERIES["op4_decision_list"][0](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(docs)
    good = bad = kept_good = kept_bad = 0
    for r in rows:
        assert tuple(r[c] for c in quality.BASE) == plain(docs[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] in labels and not r["base_failed"]:
            if labels[r["doc_id"]]:
                good, kept_good = good + 1, kept_good + r["kept"]
            else:
                bad, kept_bad = bad + 1, kept_bad + r["kept"]
    assert kept_good >= 0.98 * good and kept_bad <= 0.1 * bad


def test_held_out_accuracy(spark):
    """Rules from half of the labels judge the other half."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)) == 0
    found, _ = quality.assess(docs, labels.where(half))
    r = found.join(labels.where(~half), "doc_id").where("NOT base_failed").agg(
        F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")).alias("right"), F.count("*").alias("n")
    ).first()
    assert r["n"] > 50 and r["right"] >= 0.95
