"""Fill-in-middle: texts cut at two unit ends and put together in another order.

A unit ends after a line feed, or with the text. UTF-8 bytes are viewed as 64-bit words: bytes that end a
unit are marked arithmetically, counted per word, and the k-th mark is found by a search in the running
counts and then by byte sums inside one word. No loop over lines or characters is needed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import chunks, text_bytes
from .memory import releasing

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT_END = 0x0A
FORMS = ("plain", "psm", "spm")

ONES = np.uint64(0x0101010101010101)
LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
HIGH = np.uint64(0x8080808080808080)


@dataclass(frozen=True)
class Choice:
    """What share of texts is transformed, and of those, how many put the suffix first."""

    seed: int = 7
    percent: int = 100
    suffix_first: int = 50


class Marks:
    """One mark bit per byte of ``data``, with rank and select over all of it."""

    def __init__(self, words: np.ndarray) -> None:
        """``words``: the lowest bit of every byte is its mark, all other bits are zero."""
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of marks in the bytes before ``at``."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte << np.uint64(3))) - np.uint64(1)
        part = np.bitwise_count(self.words[np.minimum(word, len(self.words) - 1)] & below)
        return self.before[word] + part * (byte > 0)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte of the ``k``-th mark, counted from 1."""
        word = np.searchsorted(self.before, k, side="left") - 1
        rest = (k - self.before[word]).astype(np.uint64)
        # Byte i of the product counts the marks up to byte i; those with fewer than ``rest`` lie before the one wanted.
        sums = self.words[word] * ONES
        reached = ((sums | HIGH) - rest * ONES) & HIGH
        return (word << 3) + 8 - np.bitwise_count(reached)


def words_of(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian 64-bit words, with one word at least and zeros at the end."""
    padded = np.zeros((len(data) >> 3) + 1, "<u8")
    padded.view(np.uint8)[: len(data)] = data
    return padded


def equal_marks(words: np.ndarray, byte: int) -> np.ndarray:
    """The lowest bit of every byte that equals ``byte``; exact, as no carry leaves a byte."""
    x = words ^ (ONES * np.uint64(byte))
    return (~(((x & LOW7) + LOW7) | x | LOW7)) >> np.uint64(7)


def following_marks(words: np.ndarray) -> np.ndarray:
    """The lowest bit of every byte that continues a code point."""
    return (words >> np.uint64(7)) & ~(words >> np.uint64(6)) & ONES


def cut(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of every text, the byte places of its two cuts, and the code points before each cut.

    ``first`` and ``second`` are any integers; modulo the units plus one, they say how many units lie
    before a cut. Places have shape (2, texts), the lower cut first.
    """
    words = words_of(data)
    ends, following = Marks(equal_marks(words, UNIT_END)), Marks(following_marks(words))
    start, stop = offsets[:-1], offsets[1:]
    before = ends.rank(start)
    closed = ends.rank(stop) - before
    open_end = (stop > start) & (data[np.maximum(stop - 1, 0)] != UNIT_END if len(data) else False)
    units = closed + open_end
    drawn = np.sort(np.stack([first, second]) % (units + 1), axis=0)
    inside = (drawn > 0) & (drawn <= closed)
    places = np.where(drawn == 0, start, stop)
    rows = np.broadcast_to(before, drawn.shape)
    places[inside] = ends.select(rows[inside] + drawn[inside]) + 1
    points = (places - start) - (following.rank(places) - following.rank(start))
    return units, places, points


def _draws(key: Column, seed: int) -> list[Column]:
    """The first four groups of eight digits of the SHA-256 of ``seed:key`` as integers; a null key is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, choice: Choice = Choice(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``output`` for every row.

    A null text counts as empty. Empty texts, texts with one of the three signs and texts that are not
    drawn keep their form (``plain``, with null counts of characters). Draws depend on the key and the
    seed alone, so repeated rows get equal results; a null key is drawn like an empty one. Other
    columns, whatever their names, are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets):
                part = batch.slice(a, b - a)
                own = data[offsets[a] : offsets[b]]
                h1, h2, form = (part.column(i).to_numpy() for i in (2, 3, 4))
                units, places, points = cut(own, offsets[a : b + 1] - offsets[a], h1, h2)
                raw, start = own.tobytes(), (offsets[a:b] - offsets[a]).tolist()
                stop = (offsets[a + 1 : b + 1] - offsets[a]).tolist()
                made = []
                for i, kind in enumerate(form.tolist()):
                    x, y = int(places[0, i]), int(places[1, i])
                    prefix, middle, suffix = raw[start[i] : x], raw[x:y], raw[y : stop[i]]
                    if kind == 0:
                        made.append(prefix + middle + suffix)
                    elif kind == 1:
                        made.append(b"".join([b"<P>", prefix, b"<S>", suffix, b"<M>", middle]))
                    else:
                        made.append(b"".join([b"<S>", suffix, b"<P>", prefix, b"<M>", middle]))
                plain = form == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(units), pa.DictionaryArray.from_arrays(pa.array(form), list(FORMS)).cast(pa.string()),
                        pa.array(points[0], mask=plain), pa.array(points[1] - points[0], mask=plain),
                        pa.array(made, pa.binary()).cast(pa.string()),
                    ],
                    ["key", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    body = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = _draws(F.col(key), choice.seed)
    signs = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    plain = (F.length(body) == 0) | signs | (h3 % 100 >= choice.percent)
    form = F.when(plain, 0).when(h4 % 100 < choice.suffix_first, 2).otherwise(1)
    rows = docs.select(F.col(key).alias("key"), body.alias("text"), h1.alias("h1"), h2.alias("h2"), form.cast("int").alias("form"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(releasing(run), schema).withColumnRenamed("key", key)


def restored(form: str = "form", output: str = "output") -> Column:
    """The text that ``transform`` was given. Signs are found by their first place, which is exact: no
    text holds one, and none can arise where a text and a sign meet."""
    parts = F.split(F.substr(F.col(output), F.lit(len(PREFIX) + 1)), "<[PSM]>", -1)
    first, second, last = (F.get(parts, k) for k in range(3))
    return (
        F.when(F.col(form) == "psm", F.concat(first, last, second))
        .when(F.col(form) == "spm", F.concat(second, last, first))
        .otherwise(F.col(output))
    )
