"""Near duplicates by SimHash: fingerprints, pivot distance tables, and connected groups.

Two fingerprints link if they differ in at most ``radius`` bits. Pairs are looked for like this:

1. Equal fingerprints become one node, so copies cost nothing further.
2. Aligned references (fingerprints with a single bit set, and zero) give the join keys: the distance to
   them tells each bit, so the distances to the references of one block tell that block. Of ``blocks``
   blocks at most ``radius`` differ, so any linked pair agrees on ``blocks - radius`` blocks at least;
   every choice of that many blocks is one key. No linked pair is missed.
3. Rows that share a key are compared in NumPy: distances to scattered references are tabled, a pair is
   discarded at the first reference to which its distances differ by more than ``radius`` (the triangle
   inequality), and survivors are verified bit by bit.
4. Buckets of more than ``hot_rows`` nodes are keyed again on the bits they do not share yet, up to three
   times, so none has to be compared whole. A bucket gives out one link per node, not all its pairs.
5. Groups are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.operators.distribution import spread_join, stored

SEED = 42
CHUNK = 1 << 15
ROWS_OUT = 1024
PAIRS = 1 << 20
N_PIVOTS = 16
PIVOTS = np.array([xxhash.xxh64_intdigest(f"reference {i}".encode()) for i in range(N_PIVOTS)], np.uint64)


def shingles(text: str, n_words: int, distinct: bool) -> list[bytes]:
    """Runs of ``n_words`` words, space-joined; a shorter text is one run, an empty text none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    size = min(n_words, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    joined = b" ".join(words)
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths
    runs = [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]
    return [*dict.fromkeys(runs)] if distinct else runs


def fingerprint(runs: list[bytes], seed: int = SEED) -> int:
    """64 bits: a bit is 1 if more than half of the XXH64 values of ``runs`` have it."""
    if not runs:
        return 0
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(runs), CHUNK):
        part = runs[at : at + CHUNK]
        hashes = np.fromiter((digest(r, seed) for r in part), np.uint64, len(part))
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(runs)).tobytes(), "big")


def text_key(text: Column) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(text.cast("string"))


def fingerprints(docs: DataFrame, n_words: int) -> DataFrame:
    """doc_id, text_key and node, the fingerprint as a signed number. A null text counts as empty: its fingerprint is 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                rows = whole.slice(at, ROWS_OUT)
                found = [fingerprint(shingles(t or "", n_words, False)) for t in rows.column(2).to_pylist()]
                signed = pa.array(np.array(found, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*rows.columns[:2], signed], names=["doc_id", "text_key", "node"])

    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), text_key(docs["text"]).alias("text_key"), docs["text"].cast("string").alias("text")
    )
    return rows.mapInArrow(work, "doc_id long, text_key long, node long")


def _masks(bits: list[int], blocks: int, kept: int) -> list[int]:
    """All choices of ``kept`` of ``blocks`` blocks of ``bits``, each as a signed mask."""
    parts = [sum(1 << b for b in part.tolist()) for part in np.array_split(bits, blocks)]
    masks = (sum(choice) for choice in combinations(parts, kept))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keyed(nodes: DataFrame, blocks: int, radius: int) -> DataFrame:
    """Rows (mask, key, node): one for each key of each node."""
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(list(range(64)), blocks, blocks - radius)])
    return nodes.select("node", F.explode(masks).alias("mask")).select(
        "mask", F.col("mask").bitwiseAND(F.col("node")).alias("key"), "node"
    )


def _finer(rows: DataFrame, radius: int) -> DataFrame:
    """The rows of hot buckets with keys that also hold one of the blocks into which the other bits fall."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            mask, _, node = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in rows.columns)
            for m in np.unique(mask):
                free = [b for b in range(64) if not (int(m) >> b) & 1]
                own = node[mask == m]
                for more in _masks(free, min(radius + 1, len(free)), 1) if free else [0]:
                    wider = np.full(len(own), int(m) | more, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (wider, own & wider, own)], schema=rows.schema)

    return rows.mapInArrow(split, rows.schema)


def _joined_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` after joining the groups of ``a`` and ``b``; a label is the place of a group's first member."""
    while len(a):
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(labels, high[apart], low[apart])
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def _bucket_links(bucket: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all linked prints of each bucket; ``bucket`` is ascending."""
    table = np.bitwise_count(prints[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    labels = np.arange(len(prints))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    left, offset, n_pairs = np.arange(len(prints)), 0, 0
    while len(left):
        offset += 1
        left = left[left + offset < len(prints)]
        left = left[bucket[left] == bucket[left + offset]]
        a, b = left, left + offset
        for pivot in range(N_PIVOTS):
            near = np.abs(table[a, pivot] - table[b, pivot]) <= radius
            a, b = a[near], b[near]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= radius
        pairs.append((a[near], b[near]))
        n_pairs += len(pairs[-1][0])
        if n_pairs > PAIRS or not len(left):
            labels = _joined_labels(labels, *map(np.concatenate, zip(*pairs)))
            pairs, n_pairs = [], 0
    apart = np.flatnonzero((labels != np.arange(len(labels))) & (prints != prints[labels]))
    return prints[apart], prints[labels[apart]]


def _links_of(rows: DataFrame, radius: int) -> DataFrame:
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(columns: list[np.ndarray], number: np.ndarray) -> pa.RecordBatch:
            a, b = _bucket_links(number, columns[2].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        rest = None
        for rows in batches:
            new = [np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in rows.columns]
            columns = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            if not len(columns[0]):
                continue
            change = np.zeros(len(columns[0]), np.int64)
            for c in columns[:2]:
                change[1:] |= c[1:] != c[:-1]
            number = np.cumsum(change)
            cut = int(np.searchsorted(number, number[-1]))
            rest = [c[cut:] for c in columns]
            if cut:
                yield found([c[:cut] for c in columns], number[:cut])
        if rest is not None:
            yield found(rest, np.zeros(len(rest[0]), np.int64))

    dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(link, "a long, b long").distinct()


def near_links(nodes: DataFrame, radius: int, blocks: int, hot_rows: int = 8192) -> DataFrame:
    """Links (a, b) between fingerprints, rows ``node`` of 64 bits, that are at most ``radius`` bits apart.

    The links join exactly the nodes of each bucket that belong together; they are not all pairs.
    """
    rows = _keyed(nodes, blocks, radius)
    links = None
    for _ in range(3):
        sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"))
        hot = stored(sizes.filter(F.col("n") > hot_rows).drop("n"), "hot-buckets")
        if hot.isEmpty():
            break
        cool = _links_of(rows.join(hot, ["mask", "key"], "left_anti"), radius)
        links = cool if links is None else links.unionByName(cool)
        columns = rows.columns
        rows = stored(_finer(rows.join(hot, ["mask", "key"], "left_semi").select(columns), radius), "finer-keys")
    last = _links_of(rows, radius)
    return last if links is None else links.unionByName(last).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links``: the smallest node that it is connected with.

    Each round points the larger neighbours of a node, then the node itself, to its smallest neighbour;
    the number of rounds grows with the logarithm of the longest chain. Minima are aggregated before
    they are shuffled, and joined with a node's neighbours in slices where it has very many. Every round
    is written to the shared folder.
    """
    edges = stored(links.filter(F.col("a") != F.col("b")), "links")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("root")).withColumn("root", F.least("a", "root"))
        large = spread_join(both, least, ["a"], [F.col("b")]).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("root").alias("b"))
        down = large.filter(F.col("a") != F.col("b")).select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct()
        down = stored(down, "links")
        lowest = down.groupBy("a").agg(F.min("b").alias("root"))
        small = spread_join(down, lowest, ["a"], [F.col("b")]).select(F.col("b").alias("x"), "root").filter(F.col("x") != F.col("root"))
        edges = stored(
            lowest.select("a", F.col("root").alias("b")).unionByName(small.select(F.col("x").alias("a"), F.col("root").alias("b"))).distinct(),
            "links",
        )
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == last:
            break
        last = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def grouped(rows: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``rows`` (doc_id, text_key, node) with the ``first`` row of the group that their node is linked into.

    ``first`` has doc_id and text_key of the smallest doc_id reachable over links, the row's own included, and of
    its smallest text_key; rows without doc_id come last. Rows of one node are one group without any comparison.
    """
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    nodes = stored(rows.groupBy("node").agg(F.min(order).alias("first")), "nodes")
    roots = components(near_links(nodes.select("node"), radius, blocks))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    of_node = stored(spread_join(rooted.select("node", "root"), firsts, ["root"], [F.col("node")]).select("node", "first"), "components")
    return spread_join(rows, of_node, ["node"], [F.col("doc_id"), F.col("text_key")])


def simhash_groups(docs: DataFrame, n_words: int = 4, radius: int = 4, blocks: int = 6) -> DataFrame:
    """The SimHash fingerprint of every whole text and the group it is linked into.

    Result: one row per row of ``docs``: doc_id as it is, fingerprint (16 hexadecimal digits) and
    component_id, the smallest doc_id reachable over links of at most ``radius`` differing bits. Null and
    empty texts have fingerprint zero and link like any other; rows without doc_id belong to groups but
    never name them (a group of such rows alone has a null component_id). Other columns are not read; an
    empty table gives an empty result.
    """
    found = grouped(stored(fingerprints(docs, n_words), "fingerprints"), radius, blocks)
    return found.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, n_words: int = 4, radius: int = 4, blocks: int = 6) -> DataFrame:
    """One row of each group of ``simhash_groups``: that with the smallest doc_id.

    All columns are returned as they are, whatever their names. If the smallest doc_id has several texts in the
    group, that with the smallest hash stays; of rows with the same doc_id and text one stays, whichever. A
    doc_id with texts in several groups can stay in each. Rows without doc_id stay only if no row of their
    group has one, and then one does. Null and empty texts are one group (and group with fingerprints near
    zero). An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, n_words), "fingerprints")
    found = grouped(rows, radius, blocks)
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    gone = stored(found.filter(~is_first).select("doc_id", "text_key").distinct(), "near-copies")
    sizes = rows.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = stored(sizes.select("doc_id", "text_key"), "repeated-rows")

    def among(pairs: DataFrame) -> Column:
        return docs["doc_id"].cast("long").eqNullSafe(pairs["doc_id"]) & (text_key(docs["text"]) == pairs["text_key"])

    # The list grows with the table: it is broadcast at no size, so what is shuffled is the table once, at any size.
    left = docs.join(gone.hint("merge"), among(gone), "left_anti")
    if again.isEmpty():
        return left
    once = left.join(again, among(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, among(again), "left_anti").unionByName(once)
