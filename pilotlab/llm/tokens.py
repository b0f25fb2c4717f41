"""Token ids of whole texts by a ``tokenizers`` file, each distinct word encoded once by a worker."""

from __future__ import annotations

import codecs
import functools
import os
import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE = "word_bpe_49k.json"
# Words kept by a worker, about 40 bytes each. When there are more, those not met lately go.
KEPT_WORDS = 1_000_000
KEPT_BATCHES = 8
# Letters that keep their count when normalised, then signs that make one piece of their own.
PLAIN_WORD = r"^[a-zA-ZÀ-ÖØ-öø-ÿ]+[.,;:!?*$%&|#]*$"
# The library composes before it folds, and some capitals have no composed form: such texts keep their case.
COMPOSING = r"[A-Z]\p{M}"
SIGN_AT_END = r"[.,;:!?*$%&|#]$"
SIGNS_AT_END = r"([.,;:!?*$%&|#]+)$"


def _byte_letters() -> str:
    """The letter that byte-level vocabularies have for each byte. Blanks stay, and bytes of capitals give the letters of
    the small ones: A to Z, and the second bytes of À to Þ."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip(shown, map(chr, shown)))
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    letters[ord(" ")] = " "
    small = {b: b + 32 for b in (*range(0x41, 0x5B), *range(0x80, 0x9F))}
    return "".join(letters[small.get(b, b)] for b in range(256))


BYTE_LETTERS = _byte_letters()


def default_tokenizer() -> str:
    return public_tokenizers.path(WORD_BPE)


class Cache:
    """Bytes for strings, computed once for each; bounded, with the recently used half kept."""

    def __init__(self, compute: Callable[[list[str]], list[bytes]], limit: int) -> None:
        self.compute, self.limit = compute, limit
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """For each text's strings, their bytes in one."""
        recent, older = self.recent, self.older
        found = [list(map(recent.get, words)) for words in texts]
        lacking = [(words, values) for words, values in zip(texts, found) if None in values]
        new = []
        for w in {w for words, values in lacking for w, v in zip(words, values) if v is None}:
            if w in older:
                recent[w] = older[w]
            else:
                new.append(w)
        if new:
            recent.update(zip(new, self.compute(new)))
        for words, values in lacking:
            values[:] = map(recent.__getitem__, words)
        if len(recent) > self.limit // 2:
            self.older, self.recent = recent, {}
        return list(map(b"".join, found))


class WordTokenizer:
    """``encode_batch(text, add_special_tokens=False)`` for tokenizers that split at white space.

    Such a tokenizer's pieces never cross a blank or line end, and its normaliser looks at no
    neighbour beyond one, so a text's ids are those of what lies between blanks and line ends, in
    turn. Words are split and numbered in Arrow. Each distinct one is encoded by the library and kept.
    Words of plain letters, or of letters and trailing signs, are one or two pieces: many are encoded
    in one call and cut where a token ends a piece. If the file spells pieces in the letters of their bytes, the
    library's model gets plain words in that form, past the normaliser and patterns, which take longer than the model
    itself. ``__init__`` checks all this on probe texts and uses whole texts for any other tokenizer file.
    """

    PROBE = " It's  A test,\n\nÉcole ΣΑΣ é x\t y 12.5 we!! don't İx a% straße. J\u030C\n"
    PLAIN_LETTERS = [*map(chr, range(0x41, 0x5B)), *map(chr, range(0x61, 0x7B)), *(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]
    PLAIN_SIGNS = [*".,;:!?*$%&|#", ".,;:!?*$%&|#", "#|&%$*?!:;,."]

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content}
        self.added = "|".join(map(re.escape, sorted(added)))
        vocabulary = self.tokenizer.get_vocab()
        largest = max(vocabulary.values(), default=0)
        self.dtype = np.dtype("<u2" if largest < 1 << 16 else "<u4")
        self.ends = np.zeros(largest + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()
        self.by_word, self.alone = bool(self.ends.any()) and self._same("TeST X", "test x"), None
        if self.by_word:
            self.by_word = self.encode(pa.array([self.PROBE]))[0].tolist() == self._library([self.PROBE])[0].tolist()
        if self.by_word:
            self.alone = self._model_alone()
        self._forget()

    def _model_alone(self) -> object | None:
        """The file's model over pieces between blanks, if every plain letter and sign gets the same ids so."""
        from tokenizers import Tokenizer, pre_tokenizers

        alone = Tokenizer(self.tokenizer.model)
        alone.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = [*self.PLAIN_LETTERS, *(f"st{c}r" for c in self.PLAIN_LETTERS)]
        for words in (letters, [f"{w}{self.PLAIN_SIGNS[i % len(self.PLAIN_SIGNS)]}" for i, w in enumerate(letters)]):
            ids = alone.encode_batch_fast([self._spelled(pa.array(words))], add_special_tokens=False)[0].ids
            if ids != self._library([" ".join(words)])[0].tolist():
                return None
        return alone

    @staticmethod
    def _spelled(words: pa.Array) -> str:
        """Plain words as pieces between blanks, in the letters of their bytes."""
        spaced = pc.replace_substring_regex(words, SIGNS_AT_END, r" \1").cast(pa.binary())
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], spaced), b" ")[0].as_py()
        return codecs.charmap_decode(joined, "strict", BYTE_LETTERS)[0]

    def _same(self, a: str, b: str) -> bool:
        return self._library([a])[0].tolist() == self._library([b])[0].tolist()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.ids, self.sizes = np.zeros(0, self.dtype), np.zeros(0, np.int32)
        self.used, self.batch = np.zeros(0, np.int32), 0

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [np.array(e.ids, dtype=self.dtype) for e in encoded]
        return np.concatenate([np.zeros(0, self.dtype), *ids]), np.array([len(x) for x in ids], dtype=np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) in one array, and the number of ids of each.

        The library cuts added tokens out of a text before it does anything else, so a text with one,
        in whatever case, is encoded whole.
        """
        if not self.by_word:
            return self._library(texts.to_pylist())
        if not self.added:
            return self._by_words(texts)
        marked = pc.match_substring_regex(pc.ascii_lower(texts), self.added).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._by_words(texts)
        counts = np.zeros(len(texts), np.int64)
        parts = [(np.flatnonzero(~marked), self._by_words), (np.flatnonzero(marked), lambda x: self._library(x.to_pylist()))]
        parts = [(at, *encode(texts.take(pa.array(at)))) for at, encode in parts if len(at)]
        for at, _, sizes in parts:
            counts[at] = sizes
        starts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), self.dtype)
        for at, ids, sizes in parts:
            own = np.cumsum(sizes, dtype=np.int64) - sizes
            out[np.repeat(starts[at] - own, sizes) + np.arange(len(ids))] = ids
        return out, counts

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        composing = pc.match_substring_regex(texts, COMPOSING)
        folded = pc.replace_substring(pc.if_else(composing, texts, pc.ascii_lower(texts)), "\n", " ")
        split = pc.split_pattern(folded, " ")
        coded = split.flatten().dictionary_encode()
        place = self._places(coded.dictionary.cast(pa.string()))
        runs = large_binary_rows(self.ids, self.sizes).take(pa.array(place)).take(coded.indices)
        _, ends, raw = runs.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(runs) + 1] // self.dtype.itemsize if len(runs) else np.zeros(1, np.int64)
        ids = np.frombuffer(raw, self.dtype)[: ends[-1]] if ends[-1] else np.zeros(0, self.dtype)
        return ids, np.diff(ends[split.offsets.to_numpy() - split.offsets[0].as_py()])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among those kept; new ones are encoded and added."""
        if len(self.words) > KEPT_WORDS:
            self._evict()
        self.batch += 1
        found = pc.index_in(words, value_set=self.words)
        place = found.fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(place < 0)
        if len(new):
            added = words.take(pa.array(new))
            plain = pc.match_substring_regex(added, PLAIN_WORD).to_numpy(zero_copy_only=False)
            order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
            added = added.take(pa.array(order))
            n = int(plain.sum())
            for part, encode in ((added.slice(0, n), self._plain), (added.slice(n), self._other)):
                if len(part):
                    ids, sizes = encode(part)
                    self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            place[new[order]] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, added])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int32)])
        self.used[place] = self.batch
        return place

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = 1 + pc.match_substring_regex(words, SIGN_AT_END).to_numpy(zero_copy_only=False).astype(np.int64)
        if self.alone is None:
            encoded = self.tokenizer.encode_batch_fast([" ".join(words.to_pylist())], add_special_tokens=False)
        else:
            encoded = self.alone.encode_batch_fast([self._spelled(words)], add_special_tokens=False)
        ids = np.array(encoded[0].ids, dtype=self.dtype)
        ends = np.flatnonzero(self.ends[ids])[np.cumsum(pieces) - 1] + 1
        return ids, np.diff(ends, prepend=0).astype(np.int32)

    def _other(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._library(words.to_pylist())

    def _evict(self) -> None:
        keep = self.used > self.batch - KEPT_BATCHES
        self.ids = self.ids[np.repeat(keep, self.sizes)]
        self.words, self.sizes, self.used = self.words.filter(pa.array(keep)), self.sizes[keep], self.used[keep]


def large_binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]) * values.itemsize
    raw = pa.py_buffer(np.ascontiguousarray(values))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), raw])


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of ``values`` as one binary value each."""
    return large_binary_rows(values, counts).cast(pa.binary())


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of ids with ``end_id`` after it."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    return WordTokenizer(path)
