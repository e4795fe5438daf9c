"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically.

The features approximate a Gaussian kernel over the standardised statistics. The normal equations are summed per
partition and then over partitions; the model is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loginlens.llm.common import stored

#: Most labelled rows that a model is fitted on.
LABELLED_ROWS = 200_000
FEATURES = 256
#: Rows whose features a task holds at a time.
SCORED_ROWS = 1024
RIDGE = 1e-3
SEED = 7
#: Partitions that the normal equations of the bounded sample are summed in.
FIT_PARTITIONS = 32
#: Share of the raw score in the result, which keeps the order of rows that calibration makes equal.
ORDER_SHARE = 1e-3

_COUNTED = np.zeros((256, 5))
for _i, _group in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:!?'\"()-", b" \t\n\r")):
    _COUNTED[list(_group), _i] = 1
STATISTICS = (
    "log_chars", "log_words", "word_length", "word_spread", "upper", "digits", "marks", "symbols", "spaces", "shouted",
    "odd_ends", "odd_words", "distinct_words", "commonest", "distinct_triples", "short_words", "log_lines",
    "repeated_lines", "line_words", "exclaimed",
)
WORD_PIECES = 1 << 16


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; all are 0 for a null or empty one."""
    text = text or ""
    data = text.encode()
    if not data:
        return [0.0] * len(STATISTICS)
    upper, lower, digits, marks, spaces = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ _COUNTED
    size = len(data)
    letters = max(1.0, upper + lower)
    ascii_other = len(re.findall(rb"[#$%&*+/<=>@\\^_`{|}~\[\]]", data))
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    counts = Counter(words)
    triples = len(set(zip(words, words[1:], words[2:]))) if len(words) > 2 else 1
    lines = [line for line in text.split("\n") if line]
    rows = max(1, len(lines))
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        float(min(lengths.mean(), 40.0)),
        float(min(lengths.std(), 40.0)),
        float(upper / letters),
        float(digits / size),
        float(marks / size),
        float(ascii_other / size),
        float(spaces / size),
        sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n,
        sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?") / n,
        sum(c for w, c in counts.items() if not any(map(str.isalnum, w))) / n,
        len(counts) / n**0.8,
        max(counts.values(), default=0) / n,
        triples / max(1, len(words) - 2),
        float((lengths <= 3).mean()),
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / rows,
        float(np.log1p(n / rows)),
        sum(c for w, c in counts.items() if w.endswith("!")) / n,
    ]


def held_out(key: Column) -> Column:
    """Rows that no model may learn from: crc32 of the key's text is divisible by 5; a null key counts as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    coefficients: np.ndarray
    bounds: np.ndarray
    values: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        x = np.clip((rows - self.mean) / self.scale, -6.0, 6.0)
        waves = np.sqrt(2.0 / len(self.phases)) * np.cos(x @ self.weights + self.phases)
        return np.hstack([waves, np.ones((len(rows), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        parts = [self.features(rows[i : i + SCORED_ROWS]) @ self.coefficients for i in range(0, len(rows), SCORED_ROWS)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Calibrated scores in [0, 1], rising with the raw ones."""
        raw = self.raw(rows)
        plain = np.clip(raw, 0.0, 1.0)
        calibrated = np.interp(raw, self.bounds, self.values) if len(self.bounds) else plain
        return np.clip((1 - ORDER_SHARE) * calibrated + ORDER_SHARE / (1 + np.exp(-4 * (raw - 0.5))), 0.0, 1.0)


def labelled_sample(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """(key, y): up to about ``rows`` labelled keys that may be learnt from, chosen by hash, one row per key.

    Rows with a null key or label are left out; contradicting labels of a key count by their majority (ties are 1).
    """
    usable = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    known = usable.groupBy(F.col(key).alias("key")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("y"))
    total = known.count()
    if total > rows:
        known = known.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(0.95e6 * rows / total))
    return known


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = LABELLED_ROWS) -> QualityModel:
    """The model of ``label`` (1 or 0). Only the statistics of the texts enter it.

    The labelled sample has at most ``rows`` rows by its bound, so it is sent to the documents; only their statistics
    come back. A quarter of the sample is kept for calibration. Without labels every score is the same.
    """
    sample = F.broadcast(labelled_sample(labels, key, label, rows))
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(sample, "key").select("key", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.float64()))], names=["key", "y", "x"])

    key_type = source.schema["key"].dataType.simpleString()
    known = stored(source.mapInArrow(run, f"key {key_type}, y double, x array<double>"), "labelled").coalesce(FIT_PARTITIONS)
    calibrating = F.pmod(F.xxhash64(F.lit("calibration"), "key"), F.lit(4)) == 0
    d = len(STATISTICS)
    moments = known.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([moments[f"s{i}"] or 0.0 for i in range(d)])
    random = np.random.default_rng(SEED)
    model = QualityModel(
        mean=mean,
        scale=np.where(scale > 1e-9, scale, 1.0),
        weights=random.normal(scale=1.5 / np.sqrt(d), size=(d, FEATURES)),
        phases=random.uniform(0, 2 * np.pi, FEATURES),
        coefficients=np.zeros(FEATURES + 1),
        bounds=np.empty(0),
        values=np.empty(0),
    )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(len(y), d)
            for i in range(0, len(x), SCORED_ROWS):
                z = model.features(x[i : i + SCORED_ROWS])
                total += z.T @ np.hstack([z, y[i : i + SCORED_ROWS, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = known.filter(~calibrating).select("y", "x").mapInArrow(sums, "i int, row array<double>")
    # One row per partition of the sample meets here for each equation.
    added = parts.groupBy("i").agg(F.collect_list("row").alias("rows"))
    zero = F.array_repeat(F.lit(0.0), FEATURES + 2)
    added = added.select("i", F.aggregate("rows", zero, lambda a, b: F.zip_with(a, b, lambda p, q: p + q)).alias("row"))
    equations = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in added.collect():
        equations[r["i"]] = r["row"]
    count = max(1.0, equations[-1, -2])
    penalty = RIDGE * count * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    model.coefficients = np.linalg.solve(equations[:, :-1] + penalty, equations[:, -1])

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(batch.num_rows, d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.raw(x))], names=["label", "features"])

    left = stored(known.filter(calibrating).select("y", "x").mapInArrow(raws, "label double, features double"), "calibration")
    if not left.isEmpty():
        from pyspark.ml.regression import IsotonicRegression

        steps = IsotonicRegression(featuresCol="features", labelCol="label").fit(left.coalesce(FIT_PARTITIONS))
        model.bounds, model.values = steps.boundaries.toArray(), steps.predictions.toArray()
    return model


def add_scores(docs: DataFrame, model: QualityModel, text: str = "text", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all others than ``score`` if not given) and the score of each whole text; empty ones as well."""
    keep = [c for c in docs.columns if c != score] if keep is None else keep
    # A kept text is sent to the tasks once.
    source = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*source.schema.fields[: len(keep)], T.StructField(score, T.DoubleType(), False)])
    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.empty((batch.num_rows, len(STATISTICS)))
            for i, t in enumerate(batch.column(at)):
                rows[i] = statistics(t.as_py())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(model.score(rows))], names=[*keep, score])

    return source.mapInArrow(run, schema)
