"""Removal of repeated byte strings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

Every window of ``length`` bytes is named by its anchor: the position in it whose ``gram`` bytes have the least hash.
Equal windows have equal anchors, so repeats can only lie among the pieces of text (the windows that share an anchor
occurrence) whose anchor occurs twice. Equal pieces are counted together. The different pieces of an anchor meet in one
block of text; in its Burrows-Wheeler transform common prefixes are found breadth first by increasing length, and the
suffixes that no boundary below ``length`` separates begin with a repeated window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loginlens.llm.common import INVERSE, byte_values, delete_stored, mix64, powers, prefix_hash, stored, text_slices

#: Lengths of the hashed grams: the first names the anchors in texts; the others, in pieces of crowded anchors.
GRAMS = (40, 160, 190)
#: Window starts that are hashed at once; longer texts are taken in such parts.
PART_BYTES = 2 << 20
POSITION_BITS = 24
#: Bytes of pieces that one transform covers.
BLOCK_BYTES = 1 << 18
#: Different pieces of one anchor that one transform may hold. The pieces of more crowded anchors are cut anew, by
#: anchors of longer grams; what is crowded even then is counted window by window.
ANCHOR_PIECES = 500

PIECES = "k long, n long, anchor long, piece long, first long, last long"


def pieces_of(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, piece hash, first and last window start) of all pieces of the texts together."""
    span = length - gram + 1
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    if len(data) < length:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    prefix = prefix_hash(data, byte_values())
    back = powers(len(data), INVERSE)
    low = np.uint64((1 << POSITION_BITS) - 1)
    grams = mix64((prefix[gram:] - prefix[:-gram]) * back[: len(data) - gram + 1])
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    at = (least & low).astype(np.int64)
    starts = np.flatnonzero(owner[: len(at)] == owner[length - 1 :])  # windows within one text
    if not len(starts):
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    at, whose = at[starts], owner[starts]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(whose) != 0)]))
    first, last = starts[new], starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])]
    whole = mix64((prefix[last + length] - prefix[first]) * back[first] + mix64((last - first).astype(np.uint64) + np.uint64(1)))
    text = whose[new]
    return text, grams[at[new]].view(np.int64), whole.view(np.int64), first - bounds[text], last - bounds[text]


def repeated_suffixes(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece the offsets whose ``length`` bytes begin at another place of the pieces, too.

    Boundaries between neighbouring suffixes are found by the length of their common prefix. Boundaries of length 0 are
    seen from the first symbols. If a boundary of length l lies between two neighbouring occurrences of a symbol in the
    transform, the suffixes that begin with these occurrences have a boundary of length l + 1, unless they have a
    shorter one. The expansion stops before ``length``.
    """
    data = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
    n = len(data)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1) - 1  # the separators; each differs from all other symbols
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    rest = ends[owner] - np.arange(n)
    symbols = data.astype(np.int64) + 1
    symbols[ends] = 0
    # Suffix order: seven symbols first, then twice as many each time.
    padded = np.concatenate([symbols, np.zeros(8, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for j in range(7):
        key = key << 9 | np.where(rest > j, padded[j : j + n], 0)
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    step = 7
    while step <= sizes.max(initial=0):
        after = np.where(rest >= step, rank[np.minimum(np.arange(n) + step, n - 1)] + 1, 0)
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    order = np.argsort(rank, kind="stable")  # equal suffixes of two pieces in order of their separators
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    before = np.where(order > 0, symbols[order - 1], 0)  # the transform; 0 where a piece begins
    occurrences = np.argsort(before, kind="stable")
    occurrences = occurrences[np.searchsorted(before[occurrences], 1) :]
    same = before[occurrences[1:]] == before[occurrences[:-1]]
    left, right = occurrences[:-1][same].astype(np.int32), occurrences[1:][same].astype(np.int32)
    target = place[order[right] - 1].astype(np.int32)
    head = symbols[order]
    separated = np.concatenate([[True], (head[1:] != head[:-1]) | (head[1:] == 0)])
    fresh = separated
    for _ in range(1, length):
        count = np.cumsum(fresh, dtype=np.int32)
        hit = count[right] != count[left]
        found = target[hit]
        if not len(found):
            break
        fresh = np.zeros(n, dtype=bool)
        fresh[found] = True
        separated = separated | fresh
        open_ = ~hit
        left, right, target = left[open_], right[open_], target[open_]
    interval = np.cumsum(separated) - 1
    many = np.bincount(interval)[interval] > 1
    starts = np.sort(order[many & (rest[order] >= length)])
    cuts = np.searchsorted(starts, ends)
    return [starts[a:b] - (e - s) for a, b, e, s in zip([0, *cuts[:-1]], cuts, ends, sizes)]


def _runs(offsets: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if not len(offsets):
        return []
    cuts = np.flatnonzero(np.diff(offsets) != 1) + 1
    return list(zip(offsets[np.concatenate([[0], cuts])].tolist(), offsets[np.concatenate([cuts - 1, [len(offsets) - 1]])].tolist()))


def _all_pieces(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The pieces of every text (k, n, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = [t or b"" for t in batch.column(2).to_pylist()]
            for lo, hi in text_slices(rows, PART_BYTES):
                step = PART_BYTES if hi - lo == 1 else sum(map(len, rows[lo:hi])) + 1
                for at in range(0, max(1, len(rows[lo]) - length + 1) if hi - lo == 1 else 1, step):
                    part = [rows[lo][at : at + step + length - 1]] if hi - lo == 1 else rows[lo:hi]
                    which, anchor, piece, first, last = pieces_of(part, length, gram)
                    columns = [keys[lo + which], sizes[lo + which], anchor, piece, first + at, last + at]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "n", "anchor", "piece", "first", "last"])

    return texts.mapInArrow(run, PIECES)


def _piece_texts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, piece, crowded, bytes) of the wanted pieces, cut out of the texts."""
    lists = wanted.groupBy("k", "n").agg(F.collect_list(F.struct("anchor", "piece", "crowded", "first", "last")).alias("cut"))
    joined = texts.join(stored(lists, "cuts"), ["k", "n"]).select("text", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, cut = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for lo in range(0, len(cut), 4096):
                    part = cut[lo : lo + 4096]
                    columns = [
                        pa.array([c["anchor"] for c in part], pa.int64()),
                        pa.array([c["piece"] for c in part], pa.int64()),
                        pa.array([c["crowded"] for c in part], pa.bool_()),
                        pa.array([text[c["first"] : c["last"] + length] for c in part], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "piece", "crowded", "bytes"])

    return joined.mapInArrow(run, "anchor long, piece long, crowded boolean, bytes binary").dropDuplicates(["anchor", "piece"])


def _by_transform(pieces: DataFrame, length: int) -> DataFrame:
    """(anchor, piece, lo, hi): runs of window offsets in the pieces that other pieces of the anchor have, too."""
    together = pieces.select("anchor", "piece", "bytes").repartition("anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def block() -> pa.RecordBatch:
            rows = [
                (a, p, lo, hi)
                for (a, p, _), offsets in zip(held, repeated_suffixes([t for _, _, t in held], length))
                for lo, hi in _runs(offsets)
            ]
            columns = zip(*rows) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["anchor", "piece", "lo", "hi"])

        for batch in batches:
            for a, p, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if size >= BLOCK_BYTES and a != held[-1][0]:  # an anchor's pieces stay together
                    yield block()
                    held, size = [], 0
                held.append((a, p, t))
                size += len(t) + 1
        if held:
            yield block()

    return together.mapInArrow(run, "anchor long, piece long, lo long, hi long")


def _by_window(pieces: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many different pieces: their windows are counted one by one, by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            for a, p, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                offsets = range(len(t) - length + 1)
                digests = [blake2b(t[o : o + length], digest_size=16).digest() for o in offsets]
                columns = [pa.array([a] * len(offsets), pa.int64()), pa.array([p] * len(offsets), pa.int64()), pa.array(offsets, pa.int64()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "piece", "lo", "window"])

    windows = stored(pieces.select("anchor", "piece", "bytes").mapInArrow(run, "anchor long, piece long, lo long, window binary"), "windows")
    often = stored(windows.groupBy("window").agg(F.count("*").alias("c")).filter("c > 1").select("window"), "often")
    return windows.join(often, "window").select("anchor", "piece", "lo", F.col("lo").alias("hi"))


def repeated_spans(texts: DataFrame, length: int, grams: tuple[int, ...] = GRAMS, anchor_pieces: int = ANCHOR_PIECES) -> DataFrame:
    """(k, n, spans): for texts (k, n, text) the byte ranges of repeated windows, which may overlap."""
    pieces = stored(_all_pieces(texts, length, min(grams[0], length)), "pieces")
    twice = stored(pieces.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"), "anchors")
    matched = stored(pieces.join(twice, "anchor"), "matched")
    delete_stored(pieces)
    variants = matched.groupBy("anchor", "piece").agg(F.count("*").alias("copies"), F.min(F.struct("k", "n", "first", "last")).alias("one"))
    variants = stored(variants, "variants")
    kinds = stored(variants.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "kinds")
    wanted = variants.join(kinds, "anchor").select("anchor", "piece", (F.col("kinds") > anchor_pieces).alias("crowded"), "one.*")
    cut = stored(_piece_texts(texts, wanted, length), "cut")
    found = _by_transform(cut.filter("not crowded"), length)
    crowded = cut.filter("crowded")
    if not crowded.isEmpty():
        if len(grams) > 1:
            again = crowded.select(F.col("anchor").alias("k"), F.col("piece").alias("n"), F.col("bytes").alias("text"))
            inside = repeated_spans(again, length, grams[1:], anchor_pieces).select(F.col("k").alias("anchor"), F.col("n").alias("piece"), F.explode("spans").alias("s"))
            found = found.unionByName(inside.select("anchor", "piece", F.col("s.start").alias("lo"), (F.col("s.end") - length).alias("hi")))
        else:
            found = found.unionByName(_by_window(crowded, length))
    once = variants.filter("copies = 1").join(stored(found, "found"), ["anchor", "piece"])
    parts = once.select("one.k", "one.n", (F.col("one.first") + F.col("lo")).alias("start"), (F.col("one.first") + F.col("hi") + length).alias("end"))
    copied = stored(variants.filter("copies > 1").select("anchor", "piece"), "copied")
    whole = matched.join(copied, ["anchor", "piece"]).select("k", "n", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    spans = parts.unionByName(whole).groupBy("k", "n").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return stored(spans, "spans")


def remove_repeats(df: DataFrame, text: str = "text", length: int = 200, keep: list[str] | None = None, anchor_pieces: int = ANCHOR_PIECES) -> DataFrame:
    """``keep`` columns (all others if not given), ``n_bytes``, ``removed`` (byte ranges) and ``kept`` (remaining bytes).

    Texts are UTF-8 bytes, null ones empty. Each byte covered by a ``length``-byte string that also starts anywhere else,
    in the same text or another, is removed, at all of its places; matches don't cross texts, and strings are judged on
    the input. Texts shorter than ``length`` stay. Columns named like the new ones are replaced.
    """
    new = ("n_bytes", "removed", "kept")
    keep = [c for c in df.columns if c not in (text, *new)] if keep is None else keep
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    source = df.select(*keep, data.alias("__text")).withColumns({"__k": F.xxhash64("__text"), "__n": F.octet_length("__text").cast("long")})
    spans = repeated_spans(source.filter(F.col("__n") >= length).select(F.col("__k").alias("k"), F.col("__n").alias("n"), F.col("__text").alias("text")), length, anchor_pieces=anchor_pieces)
    joined = source.join(spans.select(F.col("k").alias("__k"), F.col("n").alias("__n"), F.col("spans").alias("__spans")), ["__k", "__n"], "left")
    joined = joined.select(*keep, F.col("__n").alias("n_bytes"), "__text", F.array_sort("__spans").alias("__spans"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*(joined.schema[c] for c in (*keep, "n_bytes")), T.StructField("removed", span), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(span)
        for batch in batches:
            rows = batch.column(len(keep) + 1).to_pylist()
            for lo, hi in text_slices(rows, 8 << 20):
                removed, kept = [], []
                for t, found in zip(rows[lo:hi], batch.column(len(keep) + 2).slice(lo, hi - lo).to_pylist()):
                    merged: list[list[int]] = []
                    for s in found or []:
                        if merged and s["start"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s["end"])
                        else:
                            merged.append([s["start"], s["end"]])
                    edges = [0, *(x for m in merged for x in m), len(t)]
                    kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    removed.append([{"start": a, "end": b} for a, b in merged])
                columns = [*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep) + 1)), pa.array(removed, arrow), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *new])

    return joined.mapInArrow(run, schema)
