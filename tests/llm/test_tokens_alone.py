"""Plain words by the library's model alone, and ids counted by batch."""

import json

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from pilotlab.llm import rans, tokens
from test_tokens import word_ids

PLAIN = [
    f"{word}{signs}" for i, word in enumerate(("Straße", "ÀÞþÿ", "ÉCOLE", "x" * 300, "Zürich", "ÑandÚ", "don", "s", "été"))
    for signs in ("", ".", "?!", tokens.WordTokenizer.PLAIN_SIGNS[i], "|#", "...")
]


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_plain_words_skip_the_normaliser():
    words = tokens.WordTokenizer(tokens.default_tokenizer())
    assert words.by_word and words.alone is not None
    seen = []
    words.tokenizer = type("Library", (), {"encode_batch_fast": lambda _, texts, **__: seen.extend(texts) or []})()
    ids, counts = words.encode(pa.array([" ".join(PLAIN), *PLAIN]))
    assert not any(seen)
    assert split(ids, counts) == [x[:-1].tolist() for x in word_ids([" ".join(PLAIN), *PLAIN], 0)]


@pytest.mark.parametrize("part", ["lowercase", "bytes"])
def test_other_files_keep_their_own_path(tmp_path, part):
    with open(P.path(tokens.WORD_BPE)) as file:
        given = json.load(file)
    if part == "lowercase":
        given["normalizer"]["normalizers"] = given["normalizer"]["normalizers"][:2]
    else:
        given["pre_tokenizer"]["pretokenizers"] = given["pre_tokenizer"]["pretokenizers"][:1]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(given))
    words = tokens.WordTokenizer(str(path))
    assert words.alone is None
    texts = [" ".join(PLAIN), "Some PLAIN text, été. ", ""]
    assert split(*words.encode(pa.array(texts))) == [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_ids_are_counted_by_batch(kind, monkeypatch):
    docs = [np.array(x, kind) for x in ([5, 5, 2], [2], [40_000, 7, 5, 2])]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([len(d) for d in docs]), pa.array([d.tobytes() for d in docs], pa.binary())], ["n", "ids"]
    )
    calls, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or bincount(*a, **k))
    (found,) = rans._count_ids([batch, batch.slice(0, 0), batch.slice(1, 1)])
    assert dict(zip(found["id"].to_pylist(), found["count"].to_pylist())) == {2: 4, 5: 3, 7: 1, 40_000: 1}
    assert len(calls) <= 3
