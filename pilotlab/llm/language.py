"""Language of whole texts: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

Subwords are the two to four neighbouring bytes of a word, its edges included, with ASCII letters in
lower case; what is no letter and no byte of a longer code point is an edge. A text's vector is the mean
of its subwords' embeddings. Embeddings and weights are trained together by stochastic gradient descent.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from .hashing import chunks, text_bytes
from .memory import releasing

UNKNOWN = "und"
ORDERS = (2, 3, 4)
# Windows hashed at once; bounds a task's working arrays, however long a text is.
STEP = 1 << 19
BINS = 1000


@dataclass(frozen=True)
class Training:
    """``sample_rows`` bounds the rows that the gradient sees, shared evenly by the languages; everything
    else (counts of languages, calibration, predictions) covers all rows."""

    sample_rows: int = 4000
    buckets_log2: int = 16
    dimensions: int = 16
    batch: int = 32
    steps: int = 600
    rate: float = 0.1
    seed: int = 7
    precision: float = 0.95  # of accepted predictions, on the calibration rows


def _folded(data: np.ndarray) -> np.ndarray:
    """Bytes of words, ASCII letters in lower case; zero at edges."""
    table = np.zeros(256, np.uint8)
    table[128:] = np.arange(128, 256)
    table[97:123] = table[65:91] = np.arange(97, 123)
    return table[data]


def subwords(data: np.ndarray, offsets: np.ndarray, buckets_log2: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all subwords of ``n`` texts, in pieces, each with the ``n + 1`` bounds of the texts in it."""
    n = len(offsets) - 1
    # An edge before each text and one at the end; of several edges in a row, the first is kept.
    row = np.zeros(len(data) + n + 1, np.uint8)
    folded = _folded(data)
    for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        row[a + i + 1 : b + i + 1] = folded[a:b]
    keep = row != 0
    keep[1:] |= row[:-1] != 0
    keep[0] = True
    edges = offsets + np.arange(n + 1)
    kept = np.add.reduceat(keep, edges, dtype=np.int64)
    first = np.cumsum(kept) - kept + keep[edges] - 1  # the kept edge that each text begins with
    row = np.concatenate([row[keep], np.zeros(max(ORDERS), np.uint8)])
    total = len(row) - max(ORDERS)
    for low in range(0, total, STEP):
        part = row[low : min(low + STEP, total) + max(ORDERS)]
        size = len(part) - max(ORDERS)
        inside, wide = part != 0, part.astype(np.uint32)
        for order in ORDERS:
            valid = inside[1 : 1 + size].copy() if order > 2 else inside[:size] | inside[1 : 1 + size]
            for k in range(2, order - 1):
                valid &= inside[k : k + size]
            at = np.flatnonzero(valid)
            packed = wide[at]
            for k in range(1, order):
                packed |= wide[at + k] << np.uint32(8 * k)
            packed = (packed + np.uint32(order * 0x27D4EB2F & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            packed = (packed ^ (packed >> np.uint32(15))) * np.uint32(0x85EBCA77)
            packed = (packed ^ (packed >> np.uint32(13))) >> np.uint32(32 - buckets_log2)
            yield packed, np.searchsorted(at, first - low)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between bounds; zero where there are none."""
    out = np.zeros((len(bounds) - 1, values.shape[1]))
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some], axis=0, dtype=np.float64)
    return out


@dataclass(frozen=True)
class Model:
    """Languages, and what the mean of a text's rows of ``table`` is multiplied with and added to.

    The table has one row per bucket and no more columns than the embeddings, whatever the corpus.
    """

    languages: list[str]
    table: np.ndarray
    weights: np.ndarray | None
    bias: np.ndarray
    buckets_log2: int

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        sums, counts = np.zeros((n, self.table.shape[1])), np.zeros(n, np.int64)
        for buckets, bounds in subwords(data, offsets, self.buckets_log2):
            sums += _sums(self.table[buckets], bounds)
            counts += np.diff(bounds)
        means = sums / np.maximum(counts, 1)[:, None]
        return softmax((means if self.weights is None else means @ self.weights) + self.bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _position(key: Column, seed: int) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the key's text alone."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def sample(docs: DataFrame, learn: Column, how: Training, key: str, text: str, language: str) -> pa.Table:
    """``language``, ``buckets`` and ``counts`` (binary) of about ``how.sample_rows`` rows in the order of a
    hash of their keys: a share of each language that follows from its count over all rows."""
    usable = docs.where(learn & F.col(language).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in usable.groupBy(language).count().collect()}
    if not counts:
        return pa.table({"language": pa.array([], pa.string()), "buckets": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
    want = how.sample_rows / len(counts)
    limit = F.lit(0)
    for name, count in sorted(counts.items()):
        limit = F.when(F.col(language) == name, F.lit(int(min(1.0, want / count) * 2**32))).otherwise(limit)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                data, offsets = text_bytes(batch.column(2).slice(i, 1))
                total = np.zeros(1 << how.buckets_log2, np.uint32)
                for buckets, _ in subwords(data, offsets, how.buckets_log2):
                    total += np.bincount(buckets, minlength=len(total)).astype(np.uint32)
                found = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1),
                     pa.array([found.astype("<u4").tobytes()]), pa.array([total[found].astype("<u4").tobytes()])],
                    ["place", "language", "buckets", "counts"],
                )

    place = _position(F.col(key), how.seed)
    rows = usable.where(place < limit).select(place.alias("place"), F.col(language).cast("string").alias("language"), F.col(text).alias("text"))
    found = rows.mapInArrow(releasing(run), "place long, language string, buckets binary, counts binary").toArrow()
    return found.sort_by([("place", "ascending"), ("language", "ascending"), ("buckets", "ascending"), ("counts", "ascending")]).drop_columns(["place"])


def train(rows: pa.Table, how: Training) -> Model:
    """Embeddings and softmax weights by gradient steps over batches of rows, each step scaled per
    bucket by the root of its squared gradients so far; the rate falls to zero. Equal rows in equal
    order give an equal model."""
    languages = sorted(set(rows["language"].to_pylist()))
    label = np.array([languages.index(x) for x in rows["language"].to_pylist()], dtype=np.int64)
    buckets = [np.frombuffer(x, "<u4") for x in rows["buckets"].to_pylist()]
    shares = [np.frombuffer(x, "<u4") for x in rows["counts"].to_pylist()]
    shares = [x / x.sum() for x in shares]
    rng = np.random.default_rng(how.seed)
    embedding = rng.uniform(-0.5, 0.5, (1 << how.buckets_log2, how.dimensions))
    weights, bias = np.zeros((how.dimensions, len(languages))), np.zeros(len(languages))
    squares, weight_squares = np.zeros_like(embedding), np.zeros_like(weights)
    order = np.zeros(0, np.int64)
    for step in range(how.steps if len(languages) > 1 else 0):
        if len(order) < how.batch:
            order = np.concatenate([order, rng.permutation(len(label))])
        chosen, order = order[: how.batch], order[how.batch :]
        rate = how.rate * (1 - step / how.steps)
        index, share = np.concatenate([buckets[i] for i in chosen]), np.concatenate([shares[i] for i in chosen])
        sizes = np.array([len(buckets[i]) for i in chosen])
        vectors = np.add.reduceat(embedding[index] * share[:, None], np.cumsum(sizes) - sizes, axis=0)
        error = softmax(vectors @ weights + bias)
        error[np.arange(len(chosen)), label[chosen]] -= 1
        error /= len(chosen)
        back = np.repeat(error @ weights.T, sizes, axis=0) * share[:, None]
        sorted_at = np.argsort(index, kind="stable")
        touched, first = np.unique(index[sorted_at], return_index=True)
        slope = np.add.reduceat(back[sorted_at], first, axis=0)
        squares[touched] += slope**2
        embedding[touched] -= rate * slope / np.sqrt(squares[touched] + 1e-12)
        slope = vectors.T @ error
        weight_squares += slope**2
        weights -= rate * slope / np.sqrt(weight_squares + 1e-12)
        bias -= rate * error.sum(axis=0)
    few = len(languages) <= how.dimensions
    table = (embedding @ weights if few else embedding).astype(np.float32)
    return Model(languages, table, None if few else weights, bias, how.buckets_log2)


def fit(
    docs: DataFrame, learn: Column, how: Training = Training(), key: str = "doc_id", text: str = "text", language: str = "lang"
) -> Model:
    """A model of the rows for which ``learn`` holds and that have a language and a letter. Runs two jobs;
    only counts and the sampled rows' subword counts come to the driver."""
    return train(sample(docs, learn, how, key, text, language), how)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with ``_best`` (language) and ``_raw`` (its probability). Both are null
    where the text is null or has no letter, or no language was learned."""
    names = [c for c in docs.columns if c != text]
    if not model.languages:
        return docs.select(*names, F.lit(None).cast("string").alias("_best"), F.lit(None).cast("double").alias("_raw"))
    ready = docs.select(*names, F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            data, offsets = text_bytes(texts)
            for a, b in chunks(offsets):
                part = batch.slice(a, b - a)
                found = shared.value.probabilities(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                none = ~np.asarray(part.column(part.num_columns - 1).is_valid())
                best = pa.DictionaryArray.from_arrays(pa.array(found.argmax(axis=1), mask=none), shared.value.languages)
                columns = part.columns[:-1] + [best.cast(pa.string()), pa.array(found.max(axis=1), mask=none)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "_best", "_raw"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields[:-1])
    return ready.mapInArrow(releasing(run), f"{kinds}, _best string, _raw double")


def calibrated(bins: dict[int, tuple[int, int]]) -> list[tuple[int, float]]:
    """First bin and share of right answers of each block of the rising step function nearest to
    ``bins`` (bin: rows, right ones), by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for b, (n, right) in sorted(bins.items()):
        blocks.append([b, n, right])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, n, right = blocks.pop()
            blocks[-1][1] += n
            blocks[-1][2] += right
    return [(int(b), right / n) for b, n, right in blocks]


def identify(
    docs: DataFrame, learn: Column, calibrate: Column, how: Training = Training(),
    key: str = "doc_id", text: str = "text", language: str = "lang",
) -> DataFrame:
    """``key``, ``lang_pred``, ``score``, ``accepted`` for every row, repeated rows and null keys included.

    The model learns from rows with ``learn`` and without ``calibrate``. All rows with both and with a
    language give the calibration: ``score`` is the share of right answers among those with about the
    same probability, and ``accepted`` holds where it reaches ``how.precision``. Without such rows the
    score is the probability. A null text, one without a letter, and every text where no language
    was learned is ``und`` with score 0, not accepted. Neither key nor language enters a prediction.
    Other columns are left out. Texts are read once to learn and once to predict; scored rows are
    stored, without texts, before this returns.
    """
    learn, calibrate = F.coalesce(learn, F.lit(False)), F.coalesce(calibrate, F.lit(False))
    model = fit(docs, learn & ~calibrate, how, key, text, language)
    right = F.when(learn & calibrate, F.col(language).cast("string"))
    rows = docs.select(F.col(key).alias("key"), right.alias("_right"), F.col(text).alias("text"))
    scored = cut_lineage(score(rows, model))
    bin_of = F.least(F.floor(F.col("_raw") * BINS), F.lit(BINS - 1)).cast("int")
    known = scored.where(F.col("_raw").isNotNull() & F.col("_right").isNotNull())
    counts = known.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("_best") == F.col("_right")).alias("k")).collect()
    steps = calibrated({r["bin"]: (r["n"], r["k"]) for r in counts})
    value = F.col("_raw")
    for i, (first, share) in enumerate(steps):
        value = F.lit(share) if i == 0 else F.when(bin_of >= first, F.lit(share)).otherwise(value)
    value = F.when(F.col("_raw").isNull(), F.lit(0.0)).otherwise(value)
    out = scored.select("key", F.coalesce("_best", F.lit(UNKNOWN)).alias("lang_pred"), value.alias("score"))
    return out.withColumn("accepted", (F.col("score") >= how.precision) & (F.col("lang_pred") != UNKNOWN)).withColumnRenamed("key", key)
