"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are brought into Gray order, once for each rotation that leads with another block of bits. The top nodes
of the index are the bit patterns of that block, which fingerprints within the distance share in at least one rotation.
Below a top node, runs of the Gray order are factored: an upper node holds the bits that all its members share, under a
mask. A search adds up the differing bits from the top, and drops a whole node as soon as they exceed the distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlens.llm.common import stored
from loginlens.llm.graph import components

SEED = 42
BITS = 64
#: Most fingerprints under one top node that are searched in one task; larger ones are linked through bit flips.
NODE_ROWS = 16_384
#: Rows of the index a task links, about.
TASK_ROWS = 8192
FANOUT = 8
SHINGLES_AT_ONCE = 1 << 17
PAIRS_AT_ONCE = 1 << 20


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of the text's word shingles; 0 without words. A-Z are lower-cased, nothing else."""
    import xxhash

    # bytes.lower and bytes.split know ASCII only: A-Z, and white space x20, x09 to x0D.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, total, SHINGLES_AT_ONCE):
        part = words[at : at + min(SHINGLES_AT_ONCE, total - at) + shingle - 1]
        joined = zip(*(part[i:] for i in range(shingle))) if len(words) >= shingle else [words]
        hashes = np.array([digest(s, SEED) for s in map(b" ".join, joined)], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def with_fingerprints(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["key", "fp"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code word in Gray order."""
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


class GrayIndex:
    """A tree over fingerprints in Gray order; level 0 has the fingerprints, each upper node up to ``FANOUT`` children."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        everything = np.uint64(0xFFFFFFFFFFFFFFFF)
        masks, values = [np.full(len(codes), everything)], [self.codes]
        while len(values[-1]) > FANOUT:
            starts = np.arange(0, len(values[-1]), FANOUT)
            first = values[-1][starts]
            common = np.bitwise_and.reduceat(masks[-1], starts)
            differing = np.bitwise_or.reduceat(values[-1] ^ np.repeat(first, FANOUT)[: len(values[-1])], starts)
            masks.append(common & ~differing)
            values.append(first & masks[-1])
        self.masks, self.values = masks, values

    def near(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query position, position in Gray order) that differ in at most ``distance`` bits."""
        top = len(self.values) - 1
        nodes = np.arange(len(self.values[top]))
        q = np.repeat(np.arange(len(queries)), len(nodes))
        node = np.tile(nodes, len(queries))
        gone = np.zeros(len(q), dtype=np.uint8)
        seen = np.zeros(len(q), dtype=np.uint64)
        for level in range(top, -1, -1):
            new_bits = self.masks[level][node] & ~seen
            gone = gone + np.bitwise_count((queries[q] ^ self.values[level][node]) & new_bits)
            left = gone <= distance
            q, node, gone, seen = q[left], node[left], gone[left], (seen | new_bits)[left]
            if level:
                below = len(self.values[level - 1])
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                there = child < below
                q, gone, seen = (np.repeat(x, FANOUT)[there] for x in (q, gone, seen))
                node = child[there]
        return q, node


def links_in_group(codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the distance connects: each code to the first one of its local component."""
    index = GrayIndex(codes)
    codes, n = index.codes, len(codes)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    step = max(1, PAIRS_AT_ONCE // n)
    for at in range(0, n, step):
        q, other = index.near(codes[at : at + step], distance)
        pairs = np.stack([parent[q + at], parent[other]])
        pairs = np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)
        if pairs.size:
            for a, b in pairs.T.tolist():
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            while not np.array_equal(parent, flat := parent[parent]):
                parent = flat
    linked = np.flatnonzero(parent != np.arange(n))
    return codes[linked], codes[parent[linked]]


def link_fingerprints(nodes: DataFrame, distance: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all pairs within ``distance`` bits."""
    if not 0 <= distance <= 2:
        raise ValueError("the distance must be 0, 1 or 2 bits")
    blocks = distance + 1
    width = BITS // blocks
    turned = [
        F.struct(F.lit(t).alias("turn"), (_rotate(F.col("fp"), t * width) if t else F.col("fp")).alias("code")) for t in range(blocks)
    ]
    rows = nodes.select(F.explode(F.array(*turned)).alias("r")).select("r.*")
    rows = rows.withColumn("pattern", F.shiftrightunsigned("code", BITS - width))
    counts = rows.groupBy("turn", "pattern").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(rows.join(stored(counts, "patterns"), ["turn", "pattern"]), "shared")
    grouped = shared.filter(F.col("n") <= node_rows).select("turn", "pattern", "code")
    # Links take more time than their few bytes suggest, so tasks are dealt by rows, not by bytes.
    tasks = -(-shared.count() // TASK_ROWS) or 1
    grouped = grouped.repartition(tasks, "turn", "pattern").sortWithinPartitions("turn", "pattern")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        current: tuple[int, int] | None = None

        def flush() -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
            if current is not None and held:
                a, b = links_in_group(np.concatenate(held), distance)
                if len(a):
                    yield a, b, current[0]

        def packed(found: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
            back = [[_rotate_back(x, turn * width) for x in (a, b)] for a, b, turn in found]
            columns = [np.concatenate([pair[i] for pair in back]).view(np.int64) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b"])

        for batch in batches:
            turn, pattern = (batch.column(i).to_numpy() for i in (0, 1))
            code = batch.column(2).to_numpy().view(np.uint64)
            if not len(code):
                continue
            cuts = np.flatnonzero((np.diff(turn) != 0) | (np.diff(pattern) != 0)) + 1
            found = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(code)]):
                key = (int(turn[lo]), int(pattern[lo]))
                if key != current:
                    found += flush()
                    current, held = key, []
                held.append(code[lo:hi])
            if found:
                yield packed(found)
        if found := list(flush()):
            yield packed(found)

    links = grouped.mapInArrow(run, "a long, b long")
    # Under a top node with more members, two codes are joined through a code that is at most one bit from both; a
    # centre has at most 65 codes around it, and for a distance of 1 it must be one of the two.
    crowded = shared.filter(F.col("n") > node_rows)
    if distance and not crowded.isEmpty():
        original = F.when(F.col("turn") == 0, F.col("code"))
        for t in range(1, blocks):
            original = original.when(F.col("turn") == t, _rotate(F.col("code"), BITS - t * width))
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)])
        members = crowded.select(original.alias("fp")).distinct()
        around = members.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("centre"))
        met = around.groupBy("centre").agg(F.collect_set("fp").alias("fps")).filter("size(fps) > 1")
        if distance == 1:
            met = met.filter(F.array_contains("fps", F.col("centre"))).select("fps", F.col("centre").alias("b"))
        else:
            met = met.select("fps", F.array_min("fps").alias("b"))
        links = links.unionByName(met.select(F.explode("fps").alias("a"), "b").filter("a != b"))
    return links


def _rotate(code, by: int):
    return F.shiftleft(code, by).bitwiseOR(F.shiftrightunsigned(code, BITS - by))


def _rotate_back(codes: np.ndarray, by: int) -> np.ndarray:
    return codes if by == 0 else (codes >> np.uint64(by)) | (codes << np.uint64(BITS - by))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """(key, fingerprint, component): one row per row, with the smallest key reachable over links.

    Texts link if their fingerprints differ in at most ``distance`` bits, equal ones included. Null, empty and wordless
    texts have fingerprint zero and link like any other. A null key is never the smallest one; a group of null keys
    alone has a null component. Equal fingerprints are merged first, so copies cost one row in the search.
    """
    prints = stored(with_fingerprints(df, key, text, shingle), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("copies")), "nodes")
    found = components(link_fingerprints(nodes.select("fp"), distance, node_rows)).withColumnRenamed("node", "fp")
    found = stored(found, "components")
    roots = found.join(nodes, "fp").groupBy("component").agg(F.min("least").alias("least"))
    linked = found.join(stored(roots, "roots"), "component").select("fp", F.col("least").alias("component"))
    copied = nodes.filter("copies > 1").join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component"))
    grouped = stored(linked.unionByName(copied), "grouped")
    return prints.join(grouped, "fp", "left").select(
        "key",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component", "key").alias("component"),
    )
