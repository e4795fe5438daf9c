"""Fill-in-the-middle transformation: texts are cut at two drawn units and their parts put into another order.

The units of a text stand in an indexable skip list. Every link carries how many units and how many code points it
skips; a search starts on the uppermost lane, follows each link that does not pass the rank asked for and goes one lane
down, so the widths it has added up give the code point at which the unit of that rank starts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loginlens.llm.common import text_slices

SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_PERCENT = 10
SPM_PERCENT = 20
#: One node in so many is promoted to the next lane.
FAN = 16
#: Texts of a batch are turned in pieces of about so many bytes.
SLICE_BYTES = 16 << 20
FIM = T.StructType(
    [
        T.StructField("units", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


def unit_widths(text: str, unit: re.Pattern | None) -> np.ndarray:
    """The code points of each unit: of each code point without a pattern, else of each match and of what is between."""
    if unit is None:
        return np.ones(len(text), dtype=np.uint8)
    starts = sorted({0, *(at for m in unit.finditer(text) for at in m.span()), len(text)})
    return np.diff(np.array(starts, dtype=np.int64))


class SkipList:
    """Units by rank. Lane 0 has a node for every unit and one for the end; heights are random, results are not."""

    def __init__(self, widths: np.ndarray, random: np.random.Generator, fan: int = FAN) -> None:
        self.size = len(widths)
        #: Per lane, from below: units and code points of each link (None: 1 unit), and the node below each node.
        self.lanes: list[tuple[np.ndarray | None, np.ndarray, np.ndarray | None]] = [(None, widths, None)]
        units, points = None, widths
        while len(points) > 2 * fan:
            gaps = random.geometric(1 / fan, size=len(points) // fan + 1)
            promoted = np.cumsum(gaps)
            while promoted[-1] < len(points):
                promoted = np.concatenate([promoted, promoted[-1] + np.cumsum(random.geometric(1 / fan, size=len(gaps)))])
            below = np.concatenate([[0], promoted[: np.searchsorted(promoted, len(points))], [len(points)]])
            units = np.diff(below) if units is None else np.add.reduceat(units, below[:-1])
            points = np.add.reduceat(points, below[:-1], dtype=np.int64)
            self.lanes.append((units, points, below))

    def start_of(self, rank: int) -> int:
        """The code points before the unit of this rank (0 to size; the last is the end)."""
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        node = seen = at = 0
        for units, points, below in reversed(self.lanes):
            links = len(points)
            while node < links and seen < rank:
                width = 1 if units is None else int(units[node])
                if seen + width > rank:
                    break
                seen += width
                at += int(points[node])
                node += 1
            if below is not None:
                node = int(below[node])
        return at


def transformed(text: str, draws: tuple[int, int, int, int], sentinels: tuple[str, str, str], plain: int, spm: int, unit: re.Pattern | None, random: np.random.Generator) -> tuple:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    widths = unit_widths(text, unit)
    n = len(widths)
    if not text or draws[2] % 100 >= 100 - plain or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    units = SkipList(widths, random)
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = units.start_of(first), units.start_of(second)
    p, s, m = sentinels
    if draws[3] % 100 < spm:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def draws_of(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from SHA-256 of ``seed:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    output: str = "fim",
    keep: list[str] | None = None,
    seed: int = 1,
    sentinels: tuple[str, str, str] = SENTINELS,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
    unit: str | None = None,
) -> DataFrame:
    """``keep`` columns (all others than ``output`` if not given) and a struct ``output`` of each whole text.

    It holds the number of units, the form (``plain``, ``psm`` or ``spm``), the code points of prefix and middle (null
    if plain) and the text in its new order. The units are code points, or, with an expression ``unit``, its matches and
    what stands between them. Two units drawn by the key's hash end the prefix and the middle: rows with equal keys are
    drawn alike, a null key counts as empty. Null and empty texts and those that hold a sentinel are plain; so the
    sentinels of the other forms are found again exactly. A column named ``output`` is replaced; empty tables give none.
    """
    if len(set(sentinels)) < 3 or not all(sentinels) or any(a != b and a in b or any(a.endswith(b[:i]) for i in range(1, len(b))) for a in sentinels for b in sentinels):
        raise ValueError("sentinels have to be three texts of which none is in another nor overlaps with one")
    keep = [c for c in df.columns if c != output] if keep is None else keep
    k = len(keep)
    # Columns are told by their places, so that no name clashes.
    kept = [F.col(c).alias(f"kept{i}") for i, c in enumerate(keep)]
    source = df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("text"), *[d.alias(f"draw{i}") for i, d in enumerate(draws_of(F.col(key), seed))])
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(output, FIM)])
    names = [f.name for f in FIM]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = None if unit is None else re.compile(unit, re.DOTALL)
        random = np.random.default_rng(seed)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            sizes = pc.binary_length(batch.column(k)).to_pylist()
            for first, last in text_slices([range(s) for s in sizes], SLICE_BYTES):
                part = batch.slice(first, last - first)
                draws = zip(*(part.column(k + 1 + i).to_pylist() for i in range(4)))
                rows = [transformed(t.as_py(), d, sentinels, plain_percent, spm_percent, pattern, random) for t, d in zip(part.column(k), draws)]
                fields = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.StructArray.from_arrays(fields, names=names)], names=[*keep, output])

    return source.mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of ``fill_in_middle`` was made of; null if either is null.

    The text holds no sentinel, and none can arise where a part meets one, so splitting at the sentinels gives the parts.
    """
    pieces = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    psm = F.concat(F.get(pieces, F.lit(1)), F.get(pieces, F.lit(3)), F.get(pieces, F.lit(2)))
    spm = F.concat(F.get(pieces, F.lit(2)), F.get(pieces, F.lit(3)), F.get(pieces, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
