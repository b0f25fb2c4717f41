"""What the trees are trained on, how thresholds are found, and what may be selected."""

import pytest
from pyspark.sql import functions as F

from pilotlab.llm import pii


def key(i):
    return f"AKIA{i * 7919 % 10**8:08d}QRST{i % 10000:04d}"


@pytest.fixture()
def small_sample(monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE_ROWS", 300)


def test_rare_kind_beside_many_numbers(spark, small_sample):
    """A few keys among thousands of digit groups and copies are found, whatever share of the candidates they are."""
    rows = [(i, f"the key is {key(i)} here") for i in range(60)]
    rows += [(100 + i, f"build artefact{i % 90:02d}-of-the-long-release{i} is done") for i in range(150)]
    rows += [(1000 + i, f"figures {i * 31:05d} {i * 17:05d} {i:05d} in the table") for i in range(3000)]
    rows += [(10000 + i, "a copied page of 12345 67890 and 2345 6789 01") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    proposed = pii.proposals(pii.scan(docs)).cache()
    sample = pii.training_sample(proposed)
    counts = {r["kind"]: r["count"] for r in sample.groupBy("kind").count().collect()}
    assert sum(counts.values()) <= 300 and counts["secret"] >= 100
    assert sample.select("match", "before").distinct().count() == sum(counts.values())
    found = {r["doc_id"]: [s["kind"] for s in r["pii_spans"]] for r in pii.detect(docs).where(F.col("doc_id") < 60).collect()}
    assert sum("secret" in kinds for kinds in found.values()) >= 55


def test_a_name_that_reaches_beyond_its_base_span(spark):
    """Base patterns find a part of these names only; the rest goes as well, and nothing is added where they find all."""
    rows = [(i, f"write to n{i}@example.org or call" ) for i in range(80)]
    rows += [(100 + i, f"write to müller{i}@example.org or call") for i in range(80)]
    rows += [(200 + i, f"see (o’brien{i}@example.org)") for i in range(80)]
    rows += [(300 + i, f"numbers {i * 7919:07d} {i:03d} and @ {i}") for i in range(80)]
    rows += [(400, "mixed +1 (555) 123-4567,me@x.org;10.0.0.1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert found[5] == "write to [EMAIL] or call"
    assert all(found[100 + i] == "write to [CONTACT] or call" for i in range(80))
    assert all("brien" not in found[200 + i] and "o’" not in found[200 + i] for i in range(80))
    assert found[400] == "mixed [PHONE],[EMAIL];[IP]"


def test_short_lettered_and_long_secrets(spark):
    """Values after a key word are proposed at any length, a long key as one candidate and nothing twice."""
    texts = {
        "password = hunter2.": ["hunter2"], "PASSWORD: 'open sesame please'": ["open sesame please"],
        'api_key="abcdefghijklmnopqrstuvwxyz"': ["abcdefghijklmnopqrstuvwxyz"], "token=abcdef0123456789abcdef, then": ["abcdef0123456789abcdef"],
        "\U0001f642 key " + "aB3" * 2000 + " end": ["aB3" * 2000], "the password is long": [], "password = ": [],
        "secret: \"it's 5\" and token: x": ["it's 5", "x"], 'password="' + "z1" * 50_000: ["z1" * 50_000],
        "password: ...": [], "token=" * 20_000 + "x": None, "secret=a secret=b": ["a", "b"], "1a" * 20_000: ["1a" * 20_000],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.scan(docs).collect():
        found = sorted((c["start"], c["end"], c["match"]) for c in r["pii_candidates"] if c["kind"] == "secret")
        assert all(r["text"][a:b] == m for a, b, m in found)
        expected = texts[r["text"]]
        assert expected is None or [m for *_, m in found] == expected
    assert pii.proposals(pii.scan(docs)).where("kind = 'secret' and positive = 1").count() >= 6
