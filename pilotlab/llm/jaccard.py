"""N-gram Jaccard join: linked classes of documents whose shingle sets are alike.

Exact at every size, by these steps:

1. Each document's set of 64-bit shingle hashes gets a 128-bit digest. Equal sets are one node.
2. Filter by extended prefixes in a fixed order, longest shingles first. Two sets with Jaccard t share
   at least m hashes among their ``n - ceil(t n) + m`` first ones; a set that has fewer in common with
   others is alone.
3. For the sets left, hashes are counted. A hash that no other set has adds nothing to an overlap, so
   a set needs ``ceil(t n)`` shared ones. The global order is rarest first. Sets that have a hash of
   their prefixes in this order in common form candidate groups.
4. A group's sets go into a trie in global order. Every set walks it: sets below a node share the
   overlap up to there, and subtrees are left when the remaining lengths cannot reach the threshold.
   Large groups are cut into chunks that all see a few pivots; sets that no pivot gathers then visit
   every chunk.
5. Components of the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import cut_lineage
from . import exchange
from .components import components
from .hashing import chunks, gram_hashes, mix, text_bytes, windows, word_hashes
from .memory import releasing, releasing_group, releasing_pair

SHINGLE = 5
PERCENT = 80
EXTENSION = 16  # a prefix is longer by one hash for so many of the set
BLOCK_SETS = 4096
CHUNK_SETS = 256  # a candidate group of more than two chunks is cut
PIVOTS = 8
BROADCAST_ROWS = 1_000_000  # two numbers each; beyond, the texts to read again are found by a shuffle


def _least_share(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def prefix_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, n - _least_share(n, percent) + np.maximum(1, n // EXTENSION))


def needed_in_prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """What a set surely shares in its prefix with a partner, which may be shorter."""
    return np.maximum(1, np.minimum(n, _least_share(n, percent)) // EXTENSION)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ascending distinct shingle hashes of each text, and their lengths in bytes. Fewer words than
    ``size`` are one shingle; a text without words has none."""
    data, offsets = text_bytes(texts)
    for first, last in chunks(offsets):
        own = offsets[first : last + 1] - offsets[first]
        words, counts, widths = word_hashes(data[offsets[first] : offsets[last]], own, lower=True)
        grams, bounds = gram_hashes(words, counts, size)
        before = np.concatenate([[0], np.cumsum(widths)])
        starts, _ = windows(counts, size)
        spans = before[starts + size] - before[starts] if len(starts) else starts
        for i in range(last - first):
            n = counts[i + 1] - counts[i]
            if 0 < n < size:
                total = np.uint64(n)
                for w in words[counts[i] : counts[i + 1]]:
                    total = mix(np.array([total]) * np.uint64(0x9FB21C651E98DF25) + w)[0]
                yield np.array([total], dtype=np.uint64), np.ones(1, np.int64)
            else:
                found, at = np.unique(grams[bounds[i] : bounds[i + 1]], return_index=True)
                yield found, spans[bounds[i] : bounds[i + 1]][at]


def prefix(hashes: np.ndarray, lengths: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` first hashes in the order of the filter, ascending: longest shingles first, which few
    texts share by chance, then by hash."""
    if count >= len(hashes):
        return hashes
    order = np.minimum(lengths, 255).astype(np.uint64) ^ np.uint64(255)
    order = order << np.uint64(56) | hashes >> np.uint64(8)
    return hashes[np.sort(np.argpartition(order, count)[:count])]


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _signatures(size: int, percent: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 1024):
                part = batch.slice(first, 1024)
                sets = list(shingle_sets(part.column(2), size))
                n = np.array([len(s) for s, _ in sets], dtype=np.int64)
                cut = prefix_lengths(n, percent)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array([digest(s) for s, _ in sets], pa.binary()),
                     pa.array([prefix(*s, c).tobytes() for s, c in zip(sets, cut)], pa.binary())],
                    ["key", "text_hash", "n", "node", "prefix"],
                )

    return run


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs rows of (node, n, hashes) into block rows."""
    made = TaskContext.get().partitionId() << 32
    for batch in batches:
        for first in range(0, len(batch), BLOCK_SETS):
            part = batch.slice(first, BLOCK_SETS)
            hashes = part.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([made], pa.int64()), pa.array([b"".join(part.column(0).to_pylist())], pa.binary()),
                 pa.array([part.column(1).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
                 pa.array([np.array([len(h) // 8 for h in hashes], "<i8").tobytes()], pa.binary()),
                 pa.array([b"".join(hashes)], pa.large_binary()).cast(pa.binary())],
                ["block", "nodes", "ns", "sizes", "hashes"],
            )
            made += 1


BLOCK_SCHEMA = "block long, nodes binary, ns binary, sizes binary, hashes binary"


def _block_keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.frombuffer(row["hashes"], "<u8"), return_counts=True)


def _opened(row: dict, replies: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's nodes, set sizes, bounds, hashes, and how many sets of the corpus have each hash."""
    hashes = np.frombuffer(row["hashes"], "<u8")
    ns, sizes = np.frombuffer(row["ns"], "<i8"), np.frombuffer(row["sizes"], "<i8")
    nodes = [row["nodes"][i : i + 16] for i in range(0, len(row["nodes"]), 16)]
    _, place = np.unique(hashes, return_inverse=True)
    return nodes, ns, np.cumsum([0, *sizes]), hashes, exchange.joined(replies)[place]


def _with_partner(percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        found: list[bytes] = []
        for row in block.to_pylist():
            nodes, ns, bounds, _, counts = _opened(row, replies)
            hits = np.concatenate([[0], np.cumsum(counts > 1)])
            near = hits[bounds[1:]] - hits[bounds[:-1]] >= needed_in_prefix(ns, percent)
            found += [nodes[i] for i in np.flatnonzero(near)]
        return pa.table({"node": pa.array(found, pa.binary())})

    return run


SHARED_SCHEMA = "node binary, n long, hashes binary, counts binary, heads array<long>"


def _shared(percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Sets with enough shared hashes; these in global order, with the ones of the prefix apart."""

    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in block.to_pylist():
            nodes, ns, bounds, hashes, counts = _opened(row, replies)
            for i, node in enumerate(nodes):
                h, c = hashes[bounds[i] : bounds[i + 1]], counts[bounds[i] : bounds[i + 1]]
                h, c = h[c > 1], c[c > 1]
                alone = int(ns[i]) - len(h)
                prefix = int(ns[i] - _least_share(ns[i], percent)) + 1 - alone
                if prefix < 1:
                    continue
                order = np.lexsort((h, c))
                h, c = h[order], c[order]
                out.append((node, int(ns[i]), h.tobytes(), c.astype("<i8").tobytes(), h[:prefix].astype(np.int64).tolist()))
        columns = list(zip(*out)) if out else [()] * 5
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.table(dict(zip(["node", "n", "hashes", "counts", "heads"], map(pa.array, columns, kinds))))

    return run


class Trie:
    """Radix trie of ascending integer arrays; edges hold runs of values."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]) -> None:
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        # node: edge, children, ids that end here, least and largest set size, values below, last value
        self.root: list = [np.zeros(0, np.int64), [], [], 0, 0, 0, -1]
        todo = [(self.root, order, 0)]
        while todo:
            parent, ids, depth = todo.pop()
            while ids and len(sets[ids[0]]) == depth:
                parent[2].append(ids.pop(0))
            start = 0
            while start < len(ids):
                head = sets[ids[start]][depth]
                stop = start + 1
                while stop < len(ids) and sets[ids[stop]][depth] == head:
                    stop += 1
                group = ids[start:stop]
                a, b = sets[group[0]], sets[group[-1]]
                n = min(len(a), len(b))
                differ = np.flatnonzero(a[depth:n] != b[depth:n])
                end = depth + int(differ[0]) if len(differ) else n
                own = [sizes[i] for i in group]
                child = [a[depth:end], [], [], min(own), max(own), max(len(sets[i]) for i in group) - end, int(a[end - 1])]
                parent[1].append(child)
                todo.append((child, group, end))
                start = stop

    def matches(self, values: np.ndarray, size: int, inside: np.ndarray, percent: int, skip: Callable[[int], bool]) -> Iterator[int]:
        """Ids of stored sets that reach ``percent`` with the set of ``size`` whose shared values are given."""
        todo = [(self.root, 0)]
        while todo:
            node, overlap = todo.pop()
            for child in node[1]:
                edge, below, ends, least, largest, rest, last = child
                if largest * 100 < percent * size or least * percent > 100 * size:
                    continue
                if not below and all(map(skip, ends)):
                    continue
                reached = overlap + int(np.count_nonzero(inside[edge]))
                left = min(rest, len(values) - int(np.searchsorted(values, last, side="right")))
                smallest = max(least, -(-percent * size // 100))
                if (reached + left) * (100 + percent) < percent * (size + smallest):
                    continue
                todo.append((child, reached))
            for i in node[2]:
                if not skip(i):
                    yield i, overlap


def links(rows: list[dict], percent: int) -> list[tuple[int, int]]:
    """Star links (indices) of the classes of alike sets. With a column ``guest``, only pairs with a guest count."""
    if len(rows) < 2:
        return []
    hashes = [np.frombuffer(r["hashes"], "<u8") for r in rows]
    every, first = np.unique(np.concatenate(hashes), return_index=True)
    counts = np.concatenate([np.frombuffer(r["counts"], "<i8") for r in rows])[first]
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, counts))] = np.arange(len(every))
    sets = [np.sort(rank[np.searchsorted(every, h)]) for h in hashes]
    sizes = [r["n"] for r in rows]
    trie = Trie(sets, sizes)
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    inside = np.zeros(len(every), dtype=bool)
    for i, values in enumerate(sets):
        if rows[i].get("guest") is False:
            continue
        inside[values] = True
        for j, overlap in trie.matches(values, sizes[i], inside, percent, lambda j: find(j) == find(i)):
            if 100 * overlap >= percent * (sizes[i] + sizes[j] - overlap):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        inside[values] = False
    return [(i, find(i)) for i in range(len(rows)) if find(i) != i]


def _link_table(percent: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        found = links(rows, percent)
        return pa.table({
            "u": pa.array([rows[i]["node"] for i, _ in found], pa.binary()),
            "v": pa.array([rows[j]["node"] for _, j in found], pa.binary()),
        })

    return run


def _group_links(shared: DataFrame, percent: int) -> DataFrame:
    """Links among the candidate groups of ``shared``; see step 4."""
    heads = shared.select(F.explode("heads").alias("head"), "node")
    least = heads.groupBy("head").agg(F.min("node").alias("v"))
    groups = components(heads.join(least, "head").select(F.col("node").alias("u"), "v"))
    sets = shared.drop("heads").join(groups, "node").withColumnRenamed("component", "grp")
    counted = groups.groupBy(F.col("component").alias("grp")).agg(F.count("*").alias("members"))
    parts = F.when(F.col("members") <= 2 * CHUNK_SETS, 1).otherwise(F.ceil(F.col("members") / CHUNK_SETS)).cast("int")
    sets = sets.join(counted.select("grp", parts.alias("parts")), "grp")
    sets = cut_lineage(sets.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))

    large = sets.where("parts > 1")
    nth = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("node"), "node"))
    picked = large.select("grp", "node").withColumn("nth", nth).where(F.col("nth") <= PIVOTS).select("grp", "node")
    pivots = large.join(picked, ["grp", "node"], "left_semi").withColumn("own", F.col("part"))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    shown = pivots.withColumn("part", everywhere).where("part != own").drop("own")
    columns = ["grp", "part", "node", "n", "hashes", "counts"]
    first = (
        sets.select(*columns).union(shown.select(*columns))
        .groupBy("grp", "part").applyInArrow(releasing_group(_link_table(percent)), "u binary, v binary")
    )
    first = cut_lineage(first)
    if large.isEmpty():
        return first

    # Sets outside the largest class of their group have yet to meet the other chunks.
    found = components(first)
    classed = large.select("grp", "node").join(found, "node", "left").select(
        "grp", "node", F.coalesce("component", "node").alias("class")
    )
    sizes = classed.groupBy("grp", "class").agg(F.count("*").alias("members"))
    main = sizes.groupBy("grp").agg(F.max(F.struct("members", "class")).alias("m")).select("grp", F.col("m.class").alias("class"))
    outside = classed.join(main, ["grp", "class"], "left_anti").select("grp", "node")
    # A set's chunk of visitors keeps any task to two chunks of sets.
    strangers = large.join(outside, ["grp", "node"], "left_semi").withColumn("visit", F.col("part"))
    visits = strangers.withColumn("part", everywhere)
    asked = visits.select("grp", "part", "visit").distinct()
    hosts = large.join(asked, ["grp", "part"]).withColumn("guest", F.lit(False))
    columns = ["grp", "part", "visit", "node", "n", "hashes", "counts", "guest"]
    second = (
        hosts.select(*columns).union(visits.withColumn("guest", F.lit(True)).select(*columns))
        .groupBy("grp", "part", "visit").applyInArrow(releasing_group(_link_table(percent)), "u binary, v binary")
    )
    return first.union(second)


def classes(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """``key``, ``text_hash``, ``n`` (size of its set) and ``class`` of every row; a row without shingles
    has a null class."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    signed = cut_lineage(
        rows.mapInArrow(releasing(_signatures(size, percent)), f"key {kind}, text_hash long, n long, node binary, prefix binary")
    )
    filled = signed.where("n > 0")
    nodes = filled.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    blocks = cut_lineage(nodes.select("node", "n", "prefix").mapInArrow(releasing(_blocks), BLOCK_SCHEMA), "none")
    n_keys = (blocks.agg(F.sum(F.length("hashes"))).first()[0] or 0) // 8
    replies = exchange.totals(blocks, _block_keys, exchange.ranges(n_keys))
    near = cut_lineage(
        blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(releasing_pair(_with_partner(percent)), "node binary")
    )

    # One row of each node that is left, to read its text again.
    picks = (
        filled.join(near, "node", "left_semi").groupBy("node").agg(F.min(F.struct("key", "text_hash")).alias("p"))
        .select(F.col("p.key").alias("pick"), F.col("p.text_hash").alias("pick_hash"))
    )
    picks = cut_lineage(picks)
    if picks.count() <= BROADCAST_ROWS:
        picks = F.broadcast(picks)
    again = rows.join(picks, F.col("key").eqNullSafe(F.col("pick")) & (F.col("text_hash") == F.col("pick_hash")), "left_semi")

    def full(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 2048):
                sets = [s for s, _ in shingle_sets(batch.column(0).slice(first, 2048), size)]
                yield from _blocks_of(sets)

    def _blocks_of(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [pa.array([digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([s.tobytes() for s in sets], pa.binary())],
            ["node", "n", "hashes"],
        )

    whole = again.select("text").mapInArrow(releasing(lambda b: _blocks(full(b))), BLOCK_SCHEMA)
    whole = cut_lineage(whole, "none")
    n_keys = (whole.agg(F.sum(F.length("hashes"))).first()[0] or 0) // 8
    replies = exchange.totals(whole, _block_keys, exchange.ranges(n_keys))
    shared = cut_lineage(
        whole.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(releasing_pair(_shared(percent)), SHARED_SCHEMA)
    )
    found = components(_group_links(shared, percent))

    return signed.select("key", "text_hash", "n", "node").join(found, "node", "left").select(
        "key", "text_hash", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("class")
    )


def join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id``, the least key of the rows linked with a row.

    Rows link when ``100 * intersection >= percent * union`` of their sets of ``size``-word shingles,
    A-Z lower-cased. A null text, or one without words, has an empty set and is linked with nothing. Rows that
    repeat a key stay apart rows. A null key takes no part in the least key; a class of null keys only
    has a null id. Other columns are left out.
    """
    rows = classes(docs, key, text, size, percent)
    labelled, empty = rows.where(F.col("class").isNotNull()), rows.where(F.col("class").isNull())
    least = labelled.groupBy("class").agg(F.min("key").alias("component_id"))
    joined = labelled.join(least, "class").select("key", "n", "component_id")
    joined = joined.union(empty.select("key", "n", F.col("key").alias("component_id")))
    return joined.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def representatives(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """The row of each class with the least key (null last), then text hash; rows without shingles all stay.

    Of rows equal in key and text one stays. Columns of any name are kept as they are.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    own_key, own_text = (names[docs.columns.index(c)] for c in (key, text))
    rows = cut_lineage(classes(docs, key, text, size, percent))
    named = F.struct("key", "text_hash")
    first = rows.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min_by(named, F.struct(F.col("key").isNull().alias("none"), "key", "text_hash")).alias("r")
    )
    stay = first.select("r.*").union(rows.where(F.col("class").isNull()).select("key", "text_hash").distinct())
    stay = stay.select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash"))
    own_hash = F.xxhash64(F.coalesce(F.col(own_text), F.lit("")))
    kept = renamed.withColumn("_own_hash", own_hash).join(
        stay, F.col(own_key).eqNullSafe(F.col("_key")) & (F.col("_own_hash") == F.col("_hash")), "left_semi"
    )
    repeated = rows.groupBy("key", "text_hash").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    if not repeated.isEmpty():
        kept = kept.dropDuplicates([own_key, "_own_hash"])
    return kept.select(*names).toDF(*docs.columns)
