"""Byte-level BPE through a sentencepiece model that is written directly from a rank vocabulary.

Each token becomes a piece whose characters stand for its bytes, scored by its negative rank, with identity
normalisation; so sentencepiece joins the pair of lowest rank first, leftmost on ties, which is what the ranks mean.
A pre-token that is itself a token is taken whole, as rank encoders do.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Byte b is written as the character with this number plus b: letters that no normaliser or splitter touches.
FIRST_CHARACTER = 0x100
#: The piece for unknown characters; it holds none of the byte characters, so it is no token.
UNKNOWN = "?"
REMEMBERED = 400_000
#: Texts are split and joined in pieces of about so many bytes.
SLICE_BYTES = 1 << 19
#: (characters that need the full pattern, pattern for other texts) equal to the public pre-token pattern.
PLAIN = (
    "[\x1c-\x1f\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]",
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+",
)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as file:
        pairs = (line.split() for line in file if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def as_characters(data: bytes) -> str:
    return "".join(chr(FIRST_CHARACTER + b) for b in data)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model file for a vocabulary whose ranks run from 0 without gaps; ids are ranks."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    parts = []
    for rank, token in enumerate(tokens):
        piece = _block(1, as_characters(token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
        parts.append(_block(1, piece))
    parts.append(_block(1, _block(1, UNKNOWN.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)))
    bpe, unknown_id, none = 2, len(tokens), -1
    parts.append(
        _block(
            2,
            _number(3, bpe) + _number(40, unknown_id) + b"".join(_number(f, none) for f in (41, 42, 43)) + _block(45, UNKNOWN.encode()),
        )
    )
    parts.append(_block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(parts)


class PretokenEncoder:
    """Ids of pre-tokens as little-endian 32-bit integers, with recent ones remembered."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], remembered: int = REMEMBERED):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = ranks
        self.characters = {b: FIRST_CHARACTER + b for b in range(256)}
        self.remembered = remembered
        self.known: dict[str, bytes] = {}

    def __call__(self, rows: list[list[str]]) -> list[bytes]:
        known = self.known
        missing = set().union(*rows).difference(known)
        if missing and len(known) + len(missing) > self.remembered:
            known.clear()
            missing = set().union(*rows)
        split = []
        for p in missing:
            data = p.encode()
            if (rank := self.whole.get(data)) is not None:
                known[p] = struct.pack("<i", rank)
            else:
                split.append((p, data.decode("latin-1").translate(self.characters)))
        for (p, _), ids in zip(split, self.pieces.encode([s for _, s in split], out_type=int, num_threads=1)):
            known[p] = struct.pack(f"<{len(ids)}i", *ids)
        return [b"".join(map(known.__getitem__, row)) for row in rows]


def splitter(pattern: str, plain: tuple[str, str] | None) -> Callable[[str], list[str]]:
    """All matches of the pattern; ``plain`` is (characters that need it, an equal faster pattern for other texts)."""
    import re

    import regex

    full = regex.compile(pattern).findall
    if plain is None:
        return full
    special, fast = re.compile(plain[0]).search, re.compile(plain[1]).findall
    return lambda text: full(text) if special(text) else fast(text)


def encode(
    df: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    keep: list[str] | None = None,
    plain: tuple[str, str] | None = None,
) -> DataFrame:
    """``keep`` columns (all others than ``ids`` if not given) and the token ids of each whole text.

    A null or empty text has no ids; repeated rows are encoded alike. No special tokens are recognised.
    """
    keep = [c for c in df.columns if c != ids] if keep is None else keep
    model = serialise_model(ranks)
    source = df.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern, plain)
        encoder = PretokenEncoder(model, ranks)
        for batch in batches:
            texts = batch.column(len(keep))
            for lo, hi in _row_ranges(texts):
                rows = encoder([split(t) if t else [] for t in texts.slice(lo, hi - lo).to_pylist()])
                offsets = np.cumsum([0, *(len(r) // 4 for r in rows)])
                values = np.frombuffer(b"".join(rows), dtype="<i4")
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), column], names=[*keep, ids]
                )

    return source.mapInArrow(run, schema)


def _row_ranges(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes (or list items) together."""
    from pyarrow import compute as pc

    if pa.types.is_list(column.type):
        sizes = pc.list_value_length(column)
    else:
        sizes = pc.binary_length(column)
    sizes = np.asarray(pc.fill_null(sizes, 0)).astype(np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and the bytes that the ids stand for; null or no ids give no bytes, an unknown id fails."""
    keep = [c for c in df.columns if c not in (ids, decoded)] if keep is None else keep
    tokens = sorted(ranks, key=ranks.__getitem__)
    source = df.select(*[F.col(c) for c in keep], F.col(ids).alias("__ids"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(decoded, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_bytes = np.array(tokens, dtype=object)
        for batch in batches:
            lists = batch.column(len(keep))
            for lo, hi in _row_ranges(lists, 1 << 18):
                rows = []
                for row in lists.slice(lo, hi - lo):
                    found = row.values
                    rows.append(b"".join(as_bytes[found.to_numpy(zero_copy_only=False)]) if found is not None and len(found) else b"")
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), pa.array(rows, pa.binary())], names=[*keep, decoded]
                )

    return source.mapInArrow(run, schema)
