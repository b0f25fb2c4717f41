"""Stupid-backoff scores of documents by the n-gram counts of all other documents.

Documents are packed into blocks of word codes, bucketed by block. For n = 1, 2, 3 the blocks send
their distinct n-grams to hash ranges, the count tables, and get the corpus counts back (``exchange``).
An n-gram with a part that occurs once in the corpus occurs once itself and is not sent. Each block
then joins its documents' n-grams to the counts, takes the document's own counts off, and sums.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage, stage_path
from . import exchange
from .hashing import chunks, gram_hashes, mix, text_bytes, windows, word_hashes
from .memory import releasing, releasing_pair

ORDER = 3
BACKOFF = 0.4
BLOCK_WORDS = 1 << 18
BLOCK_DOCS = 2048
DOCS_PER_BUCKET = 4096

BLOCK_SCHEMA = "block long, docs array<long>, n_words long, counts binary, vocabulary binary, codes binary"
SCORE_SCHEMA = (
    "doc long, n_words long, n_trigrams long, n_bigrams long, n_unigrams long, n_unseen long, score_millinats long"
)


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, text) to blocks. Codes number the distinct word hashes of a block in ascending order."""
    made = TaskContext.get().partitionId() << 32
    docs: list = []
    held: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    size = 0

    def block() -> pa.RecordBatch:
        words = np.concatenate(held) if held else np.zeros(0, np.uint64)
        vocabulary, codes = np.unique(words, return_inverse=True)
        narrow = codes.astype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        return pa.RecordBatch.from_arrays(
            [pa.array([made], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([len(words)], pa.int64()),
             pa.array([np.concatenate(counts).astype("<i8").tobytes()], pa.binary()),
             pa.array([vocabulary.tobytes()], pa.binary()), pa.array([narrow.tobytes()], pa.binary())],
            ["block", "docs", "n_words", "counts", "vocabulary", "codes"],
        )

    for batch in batches:
        keys = batch.column(0).to_pylist()
        data, offsets = text_bytes(batch.column(1))
        for first, last in chunks(offsets):
            own = offsets[first : last + 1] - offsets[first]
            words, bounds, _ = word_hashes(data[offsets[first] : offsets[last]], own, lower=True)
            docs += keys[first:last]
            held.append(words)
            counts.append(np.diff(bounds))
            size += len(words)
            if size >= BLOCK_WORDS or len(docs) >= BLOCK_DOCS:
                yield block()
                made, docs, held, counts, size = made + 1, [], [], [], 0
    if docs:
        yield block()


class Block:
    """A block opened with the corpus counts that are known for it so far."""

    def __init__(self, row: dict, replies: dict[int, np.ndarray]) -> None:
        self.docs = row["docs"]
        self.counts = np.frombuffer(row["counts"], "<i8")
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        self.vocabulary = np.frombuffer(row["vocabulary"], "<u8")
        n = int(self.bounds[-1])
        self.codes = np.frombuffer(row["codes"], "<u2" if len(row["codes"]) == 2 * n else "<u4")
        self.words = self.vocabulary[self.codes]
        self.of_doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.replies = replies
        self.totals: dict[int, np.ndarray] = {}
        if 1 in replies:
            self.totals[1] = replies[1][self.codes]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the n-grams, their first places, and which of them can occur more than once."""
        hashes, _ = gram_hashes(self.words, self.bounds, n)
        first, _ = windows(self.bounds, n)
        parts = self.totals[n - 1]
        return hashes, first, (parts[first] > 1) & (parts[first + 1] > 1)

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n == 1:
            return self.vocabulary, np.bincount(self.codes, minlength=len(self.vocabulary))
        for k in range(2, n):
            self.look_up(k)
        hashes, _, usable = self.grams(n)
        return np.unique(hashes[usable], return_counts=True)

    def look_up(self, n: int) -> None:
        """``totals[n]``: the corpus count of the n-gram that starts at each place; 1 where it was not sent."""
        hashes, first, usable = self.grams(n)
        out = np.ones(len(self.words) + 1, dtype=np.int64)
        if usable.any():
            _, place = np.unique(hashes[usable], return_inverse=True)
            out[first[usable]] = self.replies[n][place]
        self.totals[n] = out

    def _others(self, n: int) -> np.ndarray:
        """The count of the n-gram that starts at each place in all other documents."""
        totals = self.totals[n]
        out = np.zeros(len(self.words) + 1, dtype=np.int64)
        first = np.arange(len(self.words)) if n == 1 else windows(self.bounds, n)[0]
        first = first[totals[first] > 1]
        if not len(first):
            return out
        hashes = np.zeros(len(first), np.uint64)
        for k in range(n):
            hashes = mix(hashes + self.words[first + k])
        hashes = mix(hashes ^ mix(self.of_doc[first].astype(np.uint64) + np.uint64(1)))
        _, place, own = np.unique(hashes, return_inverse=True, return_counts=True)
        out[first] = totals[first] - own[place]
        return out

    def scores(self, n_corpus: int, alpha: float) -> list[np.ndarray]:
        for n in (2, 3):
            self.look_up(n)
        n, place = len(self.words), np.arange(len(self.words)) - self.bounds[:-1][self.of_doc]
        one, two, three = (self._others(k) for k in (1, 2, 3))
        rest = np.maximum(1, n_corpus - self.counts[self.of_doc])
        level = np.zeros(n, dtype=np.int64)  # 3: trigram … 1: unigram, 0: unseen
        value = 1.0 / (rest + 1.0)
        seen = one[:n] > 0
        level[seen], value[seen] = 1, one[:n][seen] / rest[seen]
        value = value * np.power(alpha, np.minimum(place, 2))
        for k, grams, contexts in ((2, two, one), (3, three, two)):
            # The gram that ends at p starts at p - k + 1, and so does its context of k - 1 words.
            p = np.flatnonzero(place >= k - 1)
            p = p[grams[p - k + 1] > 0]
            level[p] = k
            factor = np.power(alpha, np.minimum(place[p], 2) - (k - 1))
            value[p] = factor * (grams[p - k + 1] / contexts[p - k + 1])
        each = np.rint(1000 * np.log(value))
        columns = [np.bincount(self.of_doc, weights=level == k, minlength=len(self.counts)) for k in (3, 2, 1, 0)]
        columns.append(np.bincount(self.of_doc, weights=each, minlength=len(self.counts)))
        return [c.astype(np.int64) for c in columns]


def _opened(block: pa.Table, replies: pa.Table) -> Iterator[tuple[dict, Block]]:
    for row in block.to_pylist():
        orders = replies["n"].to_numpy()
        known = {int(n): exchange.joined(replies.filter(pa.array(orders == n))) for n in np.unique(orders)}
        for n in range(1, ORDER + 1):
            known.setdefault(n, np.zeros(0, np.int64))
        yield row, Block(row, known)


def _send_next(n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        keys, counts = [], []
        for _, opened in _opened(block, replies):
            k, c = opened.keys(n)
            keys.append(k.tobytes())
            counts.append(exchange.narrow(c))
        return pa.table({"block": block["block"], "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


def _sent(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["keys"], "<u8"), exchange.widened(row["counts"])


def _words(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return Block(row, {}).keys(1)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = BACKOFF) -> DataFrame:
    """One row for each document: ``key``, ``n_words``, how many words were scored by each order, and the
    sum of their log scores in thousandths (each rounded).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, A-Z lower-cased. With counts ``c`` over all other rows
    and ``N`` their words (at least 1), a word scores ``c(abc) / c(ab)`` for its two predecessors; where that
    count is 0 ``alpha * c(bc) / c(b)``; else ``alpha ** 2 * c(c) / N``, an unseen word counting as
    ``1 / (N + 1)``. The first words of a text start at the order they can have. A null or blank text has
    no words and a sum of 0. Repeated rows are documents each. Other columns are left out. Keys are whole
    numbers or null.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    buckets = int(min(most, max(16, rows.count() // DOCS_PER_BUCKET)))
    name = f"lm_blocks_{uuid.uuid4().hex}"
    packed = rows.mapInArrow(releasing(_pack), BLOCK_SCHEMA)
    # Bucketed, so that the answers travel to the blocks and not the blocks to the answers.
    packed.write.option("path", stage_path(spark, "blocks")).option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name)
    blocks = spark.table(name)
    sizes = blocks.agg(F.sum("n_words"), F.sum(F.length("vocabulary") / 8)).first()
    n_corpus, n_keys = int(sizes[0] or 0), int(sizes[1] or 0)

    replies = cut_lineage(
        exchange.totals(blocks, _words, exchange.ranges(n_keys)).withColumn("n", F.lit(1)), "zstd"
    )
    for n in range(2, ORDER + 1):
        out = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(releasing_pair(_send_next(n)), "block long, keys binary, counts binary")
        more = exchange.totals(out, _sent, exchange.ranges(n_corpus)).withColumn("n", F.lit(n))
        replies = replies.union(cut_lineage(more, "zstd"))

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        parts = []
        for row, opened in _opened(block, answers):
            columns = [pa.array(row["docs"], pa.int64()), opened.counts, *opened.scores(n_corpus, alpha)]
            names = [f.split()[0] for f in SCORE_SCHEMA.split(", ")]
            parts.append(pa.table(dict(zip(names, map(pa.array, columns)))))
        return pa.concat_tables(parts)

    scored = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(releasing_pair(finish), SCORE_SCHEMA)
    spark.sql(f"DROP TABLE {name}")  # the entry; the files are a stage of their own
    return scored.withColumnRenamed("doc", key)
