"""Capitals with combining marks against the tokenizer library."""

import numpy as np
import pyarrow as pa

from pilotlab.llm import tokens
from test_tokens import word_ids


def test_capitals_that_only_compose_when_small():
    texts = [f"Some WORDS {c} and {c}Ab x{c}\n{c.lower()}" for c in ("J\u030c", "T\u0308", "H\u0331", "W\u030a", "Y\u030a", "J\u0323\u030c")]
    texts += ["E\u0301COLE and MÜLLER", "Plain TEXT"]
    words = tokens.WordTokenizer(tokens.default_tokenizer())
    assert words.by_word
    ids, counts = words.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x[:-1].tolist() for x in word_ids(texts, 0)]
