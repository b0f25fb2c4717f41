"""Each stage of the pipeline against a brute-force version of its decision on the stage's own input."""

import re

import pytest

import corpus_pipeline
from pilotlab.llm import quality, templates
from pilotlab.sources.tables import cut_lineage
from test_jaccard import classes
from test_pii import plain_spans
from test_tokens import pieces_hold

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def usable(line):
    t = [templates.WILD if re.search("[0-9]", w) else w for w in WORD.findall(line)]
    constant = sum(w != templates.WILD for w in t)
    return tuple(t) if len(t) >= templates.MIN_TOKENS and 100 * constant >= templates.MIN_CONSTANT * len(t) else None


def without_recurring(rows):
    first = {}
    for key, text in sorted(rows):
        for line in text.split("\n"):
            if usable(line):
                first.setdefault(usable(line), key)
    out = {}
    for key, text in rows:
        kept = [x for x in text.split("\n") if not usable(x) or first[usable(x)] == key]
        if len(kept) == len(text.split("\n")) or WORD.search("\n".join(kept)):
            out[key] = "\n".join(kept)
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        inputs.append({r["doc_id"]: r for r in docs.collect()})
        docs = cut_lineage(stage(spark, docs, SF))
        assert docs.columns == columns
    inputs.append({r["doc_id"]: r for r in docs.collect()})

    first, second, third, fourth, last = inputs
    judged, _ = quality.assess(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(second) == {r["doc_id"] for r in judged.collect() if r["kept"]}
    assert {k: r["text"] for k, r in third.items()} == without_recurring([(k, r["text"]) for k, r in second.items()])
    assert all(r["n_chars"] == len(r["text"]) for r in third.values())
    assert set(fourth) == {c for _, _, c in classes([(k, r["text"]) for k, r in third.items()])}
    assert set(last) == set(fourth)
    for key, row in fourth.items():
        spans = plain_spans(row["text"])
        new = last[key]["text"]
        assert all(row["text"][a:b] not in new for a, _, b, kind in spans if kind in ("email", "card", "phone"))
        assert spans or "[EMAIL]" not in new
    pieces_hold(corpus_pipeline.pack(spark, docs, SF).collect(), {k: r["text"] for k, r in last.items()})


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("rows", [[], [(None, None), (1, None), (1, None), (2, ""), (2, ""), (3, "word " * 70_000), (4, "a b")]])
def test_odd_tables(spark, rows):
    """Every stage takes nulls, repeated rows, and columns named like its own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key int, node string, kept int, place int, line int"
    docs = spark.createDataFrame([(k, t, None, "s", None, 1, "n", 2, 3, 4) for k, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF).collect()
        if name == "near duplicates":
            assert len(found) == len({r for r in rows})
        elif name in ("line dedup", "personal data"):
            assert sorted((str(r["doc_id"]), str(r["text"])) for r in found) == sorted((str(k), str(t)) for k, t in rows)
        elif name == "quality rules":
            assert found == []
