"""Personal data against the plain patterns, redaction, and what the trees add."""

import hashlib
import re

import pytest

from pilotlab.llm import pii, queries

SF = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


ODD = [
    None, "", "  ", "a@b.c a@b.c%d@e.f.g +@x.y a@b@c.d a@b a@b. @c.d x.@-.- \U0001f642é q@w.e",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 1.2.3 1..2.3.4 00000.0.0.0",
    "4111 1111 1111 1111, 4111111111111111x 4111-1111-1111-1112 4111  1111 1111 1111 37828224631000 5",
    "+1 (555) 123-4567 +1+15551234567 +49.30.1234567890 +123 +1 555 123 4567 8901 23 +1-----5551234567)",
    "a" * 20_000, "9" * 100_000, "1." * 20_000, "+" * 50_000, "a@b.c " * 3000, "a@" * 6_000, "x.y@z" + ".w" * 60_000,
    "mixed +1 (555) 123-4567,me@x.org;10.0.0.1\n4111111111111111",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "k", 1) for i, t in enumerate(ODD)] + [(None, "me@x.org", "k", 1), (3, ODD[3], "k", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string, start int").repartition(4)


def test_base_spans_equal_plain_patterns(spark, odd):
    found = pii.detect(odd).collect()
    assert len(found) == len(ODD) + 2
    for r in found:
        assert [tuple(s) for s in r["pii_base"]] == plain_spans(r["text"])
        assert set(map(tuple, r["pii_base"])) <= set(map(tuple, r["pii_spans"]))
    assert pii.detect(odd.limit(0)).collect() == []


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_boosted_pii"][0](spark, SF).collect()
    assert len(rows) == len(docs)
    keys, caught, extra = 0, 0, 0
    for r in rows:
        base = plain_spans(docs[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        for kind in PLAIN:
            assert r[f"n_{kind}"] == sum(k == kind for *_, k in base)
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert spans == sorted(spans, key=lambda s: (int(s[1]), pii.KINDS.index(s[0])))
        assert {(int(a), pii.KINDS.index(k), int(b), k) for k, a, b in spans} >= set(base)
        known = [m.span(1) for m in re.finditer(r"(?<![A-Z0-9])(AKIA[0-9A-Z]{16})", docs[r["doc_id"]])]
        known += [m.span(1) for m in re.finditer(r"(?:password|token)\s*=\s*\"?([0-9a-f]{16,})", docs[r["doc_id"]])]
        added = {(int(a), int(b)) for k, a, b in spans if k not in PLAIN}
        keys, caught = keys + len(known), caught + sum(k in added for k in known)
        extra += len(added - set(known))
    assert keys > 10 and caught >= 0.95 * keys and extra <= 0.1 * keys


def test_redact(spark, odd):
    rows = {r["doc_id"]: r for r in pii.redact(odd).where("doc_id >= 0").collect()}
    assert rows[0]["text"] is None and rows[1]["text"] == "" and rows[2]["kind"] == "k"
    assert rows[len(ODD) - 1]["text"] == "mixed [PHONE],[EMAIL];[IP]\n[CARD]"
    assert rows[11]["text"] == "[EMAIL] " * 3000
