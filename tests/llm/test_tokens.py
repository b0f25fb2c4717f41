"""Encoders, coded files and packing against the tokenizer libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pilotlab.llm import bpe, packing, rans, tokens
from pilotlab.sources.tables import stage_path

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", "   \n", "a b", "a b", " \x1c\x1d x\x85y᠎ c   d\n\n 12.5 It's we!!",
    "ab" * 3000 + " \U0001f642 é́", "İx Ñandú, ΣΑΣ <|endoftext|>", "word " * 30_000,
    "a <|endoftext|> b", "<|startoftext|>hi", "x<|EndOfText|>y <|endoftext|><|endoftext|>\n", "plain again",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [Row(doc_id=i if i != 3 else None, text=t, key=7, ids=b"x", start=1) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, key int, ids binary, start int").repartition(3)


def word_ids(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(tokens.WORD_BPE))
    return [np.array([*e.ids, end], dtype="<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_word_cache_equals_library():
    assert tokens.WordTokenizer(tokens.default_tokenizer()).by_word
    ids, counts = tokens.tokenizer(tokens.default_tokenizer()).encode(pa.array([t or "" for t in ODD]))
    found = np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in found] == [x[:-1].tolist() for x in word_ids(ODD, 0)]


def test_byte_bpe(spark, docs):
    import tiktoken

    with open(P.path(bpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    given = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    corpus = spark.read.parquet(f"{SF}/documents.parquet")
    given |= {r["doc_id"] + 1000: r["text"] for r in corpus.collect()}
    both = docs.select("doc_id", "text").union(corpus.select(F.col("doc_id") + 1000, "text"))
    found = bpe.decode(bpe.encode(both)).collect()
    assert len(found) == len(given)
    for r in found:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(given[r["doc_id"]])
        assert bytes(r["decoded"]) == given[r["doc_id"]].encode()
    assert bpe.decode(bpe.encode(docs.limit(0))).collect() == []


@pytest.mark.parametrize("n", [0, 1, 5, 1000, rans.LANES * rans.SEGMENT_STEPS + 777])
def test_rans_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_000).astype(np.int64)
    values, counts = np.unique(ids, return_counts=True)
    table = rans.FrequencyTable(values, counts)
    assert len(values) == 0 or table.frequencies.sum() == 1 << table.bits
    block = rans.encode_block(table, ids)
    stored = rans.FrequencyTable.stored(values[::-1], table.frequencies[::-1])
    assert (rans.decode_block(stored, stored.at_slot(), block) == ids).all()
    width = block["lanes"] * rans.SEGMENT_STEPS
    for k in range(-(-n // width)):
        part = rans.decode_block(stored, stored.at_slot(), block, range(k, k + 1))
        assert (part == ids[k * width : (k + 1) * width]).all()


def test_rans_finds_damage():
    ids = np.arange(5000) % 37
    table = rans.FrequencyTable(*np.unique(ids, return_counts=True))
    block = rans.encode_block(table, ids)
    damaged = bytearray(block["payload"])
    damaged[len(damaged) // 2] ^= 1
    with pytest.raises((ValueError, IndexError)):
        rans.decode_block(table, table.at_slot(), block | {"payload": bytes(damaged)})


def test_token_files(spark, docs):
    both = docs.union(docs.where("doc_id = 4"))
    path = stage_path(spark, "tokens")
    rans.write(rans.token_rows(both), path)
    found = rans.read(spark, path).orderBy("start").collect()
    given = sorted(both.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    expected = word_ids([r["text"] for r in given], 2)
    starts = np.cumsum([0, *map(len, expected)])
    assert [r["doc_id"] for r in found] == [r["doc_id"] for r in given]
    assert [r["start"] for r in found] == starts[:-1].tolist()
    assert [bytes(r["ids"]) for r in found] == [x.tobytes() for x in expected]
    empty = stage_path(spark, "tokens")
    rans.write(rans.token_rows(docs.limit(0)), empty)
    assert rans.read(spark, empty).collect() == []


def pieces_hold(found, texts):
    """Pieces rebuild every document, sequences have no gaps and are full or a power of two."""
    expected = {k: x.tobytes() for k, x in zip(texts, word_ids(texts.values(), 1))}
    for key, whole in expected.items():
        own = sorted((r for r in found if r["doc_id"] == key), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own) == whole
        assert all(r["doc_tokens"] * 4 == len(whole) and r["length"] * 4 == len(r["ids"]) for r in own)
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
    sequences: dict = {}
    for r in sorted(found, key=lambda r: r["offset"]):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= packing.SEQUENCE and n & (n - 1) == 0 for n in sequences.values())


def test_pack(spark, docs):
    pieces_hold(packing.pack(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    corpus = spark.read.parquet(f"{SF}/documents.parquet")
    pieces_hold(packing.pack(corpus).collect(), {r["doc_id"]: r["text"] for r in corpus.collect()})
    assert packing.pack(docs.limit(0)).collect() == []
    twice = packing.pack(docs.where("doc_id = 4").union(docs.where("doc_id = 4"))).collect()
    assert sum(r["length"] for r in twice) == 2 * len(word_ids(["a b"], 1)[0])


def test_hilbert_keys_are_a_curve():
    """Every cell once, and cells that follow each other are neighbours."""
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    walked = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walked, axis=0)).sum(axis=1) == 1).all()


def test_query_digests(spark):
    from pilotlab.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    expected = word_ids([r["text"] for r in docs], 2)
    starts = np.cumsum([0, *map(len, expected)])
    packed = queries.QUERIES["op3_pack_hilbert"][0](spark, SF).collect()
    for d, x in zip(docs, word_ids([r["text"] for r in docs], 1)):
        own = sorted((r for r in packed if r["doc_id"] == d["doc_id"]), key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
        assert sum(r["length"] for r in own) == len(x) and all(r["doc_tokens"] == len(x) for r in own)
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) for r in own]

    import tiktoken

    with open(P.path(bpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r["doc_id"]: r for r in queries.QUERIES["op8_byte_bpe"][0](spark, SF).collect()}
    for d in docs:
        x = np.array(library.encode_ordinary(d["text"]), dtype="<u4")
        assert tuple(found[d["doc_id"]]) == (
            d["doc_id"], len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest()
        )

    rows = queries.QUERIES["op10_rans_tokens"][0](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [
        (d["doc_id"], s, len(x), zlib.crc32(x.tobytes())) for d, s, x in zip(docs, starts.tolist(), expected)
    ]
