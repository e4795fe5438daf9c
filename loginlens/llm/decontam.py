"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items. Tables for blocks of two words tell how far a search may shift;
where the shift is zero, the block's bucket gives the windows that end in it, and their words are compared directly.
A whole batch of documents is searched at once, in many lanes that shift independently.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loginlens.llm.common import BASE, INVERSE, byte_values, mix64, powers, prefix_hash, text_slices

#: Words are runs of ASCII digits, ASCII letters (lower-cased) and all bytes from 0x80 on.
WORD_BYTES = np.array([b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
SHIFT_BITS = 18
LANE_WORDS = 256
HASHED_BYTES = 1 << 20
#: Bytes of benchmark text that one pass searches for; a larger benchmark takes more passes.
PASS_BYTES = 16 << 20


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in lower-cased bytes."""
    inside = WORD_BYTES[data].view(np.int8)
    edges = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hashes = np.empty(len(starts), dtype=np.uint64)
    values = byte_values()
    at = 0
    while at < len(starts):  # in steps, as the hashes take eight times the text
        last = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED_BYTES)))
        lo, hi = starts[at], ends[last - 1]
        prefix = prefix_hash(data[lo:hi], values)
        s, e = starts[at:last] - lo, ends[at:last] - lo
        hashes[at:last] = mix64((prefix[e] - prefix[s]) * powers(hi - lo, INVERSE)[s] + (e - s).astype(np.uint64))
        at = last
    return starts, ends, hashes


@dataclass
class _Class:
    """Windows of one length: shift table, and the windows by the hash of their last block and of all words."""

    length: int
    block: int
    shift: np.ndarray
    ends: np.ndarray  # sorted hashes of the windows' last blocks
    keys: np.ndarray  # sorted hashes of whole windows
    texts: list[list[bytes]]  # by key: the windows with that hash, as words joined by spaces
    items: list[list[list[int]]]  # by key and window: numbers of the items


def _block_hash(words: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    return words[at] if block == 1 else mix64(words[at - 1] * np.uint64(BASE) + words[at])


def _window_hash(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(length):
        out = out * np.uint64(BASE) + words[at - (length - 1 - j)]
    return mix64(out)


def build_tables(items: list[bytes], window: int) -> list[_Class]:
    """Search tables by window length; items shorter than the window are one window, empty ones none."""
    by_length: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = defaultdict(dict)
    for number, text in enumerate(items):
        data = LOWER[np.frombuffer(text, dtype=np.uint8)]
        starts, ends, hashes = words_of(data)
        words = [data[s:e].tobytes() for s, e in zip(starts, ends)]
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if length else 0):
            by_length[length].setdefault(b" ".join(words[i : i + length]), (hashes[i : i + length], set()))[1].add(number)
    tables = []
    for length, windows in sorted(by_length.items()):
        block = min(2, length)
        most = length - block + 1
        shift = np.full(1 << SHIFT_BITS, most, dtype=np.int16)
        matrix = np.array([w for w, _ in windows.values()], dtype=np.uint64).reshape(len(windows), length)
        flat, base = matrix.ravel(), np.arange(len(windows)) * length
        for j in range(block - 1, length):
            places = (_block_hash(flat, base + j, block) & np.uint64((1 << SHIFT_BITS) - 1)).astype(np.int64)
            np.minimum.at(shift, places, length - 1 - j)
        whole = _window_hash(flat, base + length - 1, length)
        keys = np.unique(whole)
        texts: list[list[bytes]] = [[] for _ in keys]
        numbers: list[list[list[int]]] = [[] for _ in keys]
        for (text, (_, which)), k in zip(windows.items(), np.searchsorted(keys, whole)):
            texts[k].append(text)
            numbers[k].append(sorted(which))
        tables.append(_Class(length, block, shift, np.unique(_block_hash(flat, base + length - 1, block)), keys, texts, numbers))
    return tables


def _scan(table: _Class, words: np.ndarray) -> np.ndarray:
    """Positions of last words at which a window of the table may end, by shifting in lanes."""
    first = np.arange(table.length - 1, len(words), LANE_WORDS)
    stop = np.minimum(first + LANE_WORDS, len(words))
    at, found = first.copy(), []
    mask = np.uint64((1 << SHIFT_BITS) - 1)
    while len(at):
        block = _block_hash(words, at, table.block)
        shift = table.shift[(block & mask).astype(np.int64)].astype(np.int64)
        zero = shift == 0
        if zero.any():
            ends, where = block[zero], at[zero]
            place = np.minimum(np.searchsorted(table.ends, ends), len(table.ends) - 1)
            found.append(where[table.ends[place] == ends])
        at = at + np.maximum(shift, 1)
        going = at < stop
        at, stop = at[going], stop[going]
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def search(tables: list[_Class], texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
    """For each text: its number of words, the merged word ranges inside occurrences, and the items found."""
    data = LOWER[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
    starts, ends, hashes = words_of(data)
    text_starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(text_starts, starts, side="right") - 1
    n_words = np.bincount(owner, minlength=len(texts))
    first_word = np.concatenate([[0], np.cumsum(n_words)])
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    items: dict[int, set[int]] = defaultdict(set)
    for table in tables:
        if len(hashes) < table.length:
            continue
        at = _scan(table, hashes)
        at = at[owner[at] == owner[at - table.length + 1]]
        whole = _window_hash(hashes, at, table.length)
        place = np.minimum(np.searchsorted(table.keys, whole), len(table.keys) - 1)
        same = table.keys[place] == whole
        for last, k in zip(at[same].tolist(), place[same].tolist()):
            begin = last - table.length + 1
            text = b" ".join(data[starts[w] : ends[w]].tobytes() for w in range(begin, last + 1))
            for window, numbers in zip(table.texts[k], table.items[k]):
                if window == text:
                    edges[begin] += 1
                    edges[last + 1] -= 1
                    items[int(owner[last])].update(numbers)
    hit = np.cumsum(edges[:-1]) > 0
    out = []
    for i, n in enumerate(n_words.tolist()):
        spans: list[tuple[int, int]] = []
        if i in items:
            flags = np.diff(hit[first_word[i] : first_word[i + 1]].astype(np.int8), prepend=0, append=0)
            spans = list(zip(np.flatnonzero(flags == 1).tolist(), np.flatnonzero(flags == -1).tolist()))
        out.append((n, spans, items.get(i, set())))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _one_pass(df: DataFrame, text: str, found: str, items: list[tuple[str | None, bytes]], window: int, again: bool) -> DataFrame:
    """Search all rows for one block of items; with ``again``, add to what earlier passes found."""
    keep = [c for c in df.columns if c != found]
    source = df.select(*keep, *([found] if again else []))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField(found, FOUND)])
    at = keep.index(text)
    tables = build_tables([t for _, t in items], window)
    names = [n for n, _ in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        for batch in batches:
            from pyspark.sql.pandas.types import to_arrow_type

            arrow = arrow or to_arrow_type(FOUND)
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            earlier = batch.column(len(keep)).to_pylist() if again else [None] * len(texts)
            rows = []
            for lo, hi in text_slices(texts):
                for (n, spans, numbers), old in zip(search(tables, texts[lo:hi]), earlier[lo:hi]):
                    ids = {names[i] for i in numbers} - {None}
                    if old:
                        ids |= set(old["items"])
                        spans = _merged([*spans, *((s["start"], s["end"]) for s in old["spans"])])
                    rows.append({"n_words": n, "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(ids)})
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(rows, arrow)], names=[*keep, found])

    return source.mapInArrow(run, schema)


def find_contamination(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    found: str = "contamination",
    window: int = 10,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """All rows and columns, with a struct ``found``: number of words, word ranges inside benchmark windows, items.

    Every window of ``window`` consecutive item words counts, and a shorter item is one window. Null and empty texts
    have no words. Items without text have no windows; an item without id marks words but is not listed; repeated
    items count once. Item numbers are listed as strings in string order. A column named like ``found`` is replaced.
    The benchmark is sent to the tasks in blocks of at most ``pass_bytes`` of text (or one longer item), one pass over
    the rows for each block; blocks are formed by a hash of the items, and only one is on the driver at a time.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("binary").alias("text")).filter("length(text) > 0")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // pass_bytes) if total > pass_bytes else 1)
    out, again = df, False
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        rows = [(r["id"], bytes(r["text"])) for r in part.collect()]
        out, again = _one_pass(out, text, found, rows, window, again), True
    return out
