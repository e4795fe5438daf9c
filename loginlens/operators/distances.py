"""Distances between two blocks of vectors, with lower bounds to a box of vectors.

Each metric gives the distances of every query to every reference row of a block, and the least
distance any vector inside an axis-aligned box could have, so that blocks that cannot matter are
never compared. Metrics on many coordinates also have a screen: a matrix product in single precision,
with room for its rounding, that tells which pairs of a block could lie within a limit. Only these
are then compared in full.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Array = np.ndarray

# The accepted metric names.
METRICS = [
    "cityblock", "cosine", "euclidean", "l1", "l2", "manhattan", "braycurtis", "canberra", "chebyshev",
    "correlation", "dice", "hamming", "jaccard", "kulsinski", "mahalanobis", "matching", "minkowski",
    "rogerstanimoto", "russellrao", "seuclidean", "sokalmichener", "sokalsneath", "sqeuclidean", "yule",
]


@dataclass(frozen=True)
class Metric:
    """``prepare`` maps vectors once; all others work on prepared vectors.

    ``rows`` gives the distances of two blocks row by row, ``rough`` the same but for the rounding of sums, and faster.
    ``screen(r)`` takes references, then queries, and answers
    ``look(rows, begin, end, limit)``: which of these references may lie within the limits of these queries. It holds for
    values that ``screened`` accepts.
    """

    prepare: Callable[[Array], Array]
    pairs: Callable[[Array, Array], Array]
    bound: Callable[[Array, Array, Array], Array]
    rows: Callable[[Array, Array], Array] | None = None
    rough: Callable[[Array, Array], Array] | None = None
    screen: Callable[[Array], Callable] | None = None


SINGLE = float(np.finfo(np.float32).eps)
CELLS, FEW_CELLS, KNOTS = 12, 6, 8  # intervals and points a coordinate is cut into for screens
PIECE = 512  # pairs compared at once


def screened(x: Array) -> bool:
    """Whether single precision holds the values, their squares and their ratios."""
    size = np.abs(x[x != 0])
    return not len(size) or bool(size.max() < 1e12 and size.min() > 1e-15)


def _by_rows(term: Callable[[Array, Array], Array], finish: Callable[[Array], Array] = lambda x: x, join=np.add):
    """``rows`` and ``rough``; the former joins coordinates in the order ``_summed`` has."""

    def rows(a: Array, b: Array) -> Array:
        # Coordinates by rows are joined one after the other; along a row numpy would add them in another order.
        return finish(join.reduce(term(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)), axis=0))

    return rows, lambda a, b: finish(join.reduce(term(a, b), axis=1))


def _square_screen(limit_of: Callable[[Array], Array]):
    """Screen for Euclidean distances: squares of two lengths less twice the inner product."""

    def screen(r: Array):
        slack = 8 * (r.shape[1] + 8) * SINGLE
        centre = np.median(r[:: max(1, len(r) // 4096)], axis=0)
        moved = r - centre
        right = np.concatenate([moved.T, (moved * moved).sum(axis=1)[None] * (1 - slack)]).astype(np.float32)

        def ask(q: Array):
            x = q - centre
            own = (x * x).sum(axis=1)
            left = np.concatenate([2 * x, np.full((len(x), 1), -1.0)], axis=1).astype(np.float32)

            def look(rows: Array, begin: int, end: int, limit: Array) -> Array:
                reach = limit_of(limit)
                least = own[rows] - reach - slack * (own[rows] + reach) - 1e-30
                return ~(left[rows] @ right[:, begin:end] < least.astype(np.float32)[:, None])

            return look

        return ask

    return screen


def _angle_screen(r: Array):
    right, slack = r.T.astype(np.float32), 8 * (r.shape[1] + 8) * SINGLE

    def ask(q: Array):
        left = q.astype(np.float32)
        return lambda rows, begin, end, limit: ~(left[rows] @ right[:, begin:end] < (1 - limit - slack).astype(np.float32)[:, None])

    return ask


def _cells(r: Array, cells: int) -> tuple[Array, Array, Array]:
    """Every coordinate cut into intervals of about equal numbers of rows: (rows x coordinates * intervals) 0/1, and the
    least and largest value inside each interval."""
    some = r[:: max(1, len(r) // 4096)]
    cuts = np.quantile(some, np.arange(1, cells) / cells, axis=0)
    cell = sum((r > c).astype(np.int8) for c in cuts)
    inside = np.empty((*r.shape, cells), dtype=np.float32)
    low, high = np.zeros((r.shape[1], cells)), np.zeros((r.shape[1], cells))
    for c in range(cells):
        held = cell == c
        inside[:, :, c] = held
        any_row = held.any(axis=0)
        low[:, c] = np.where(any_row, np.where(held, r, np.inf).min(axis=0), 0.0)
        high[:, c] = np.where(any_row, np.where(held, r, -np.inf).max(axis=0), 0.0)
    return inside.reshape(len(r), -1), low, high


def _cell_screen(term: Callable[[Array, Array], Array], largest: bool = False):
    """Screen for distances joined coordinate by coordinate: the least terms that the intervals of a reference allow, summed
    by one product; for the largest term, how many coordinates alone exceed the limit."""

    def screen(r: Array):
        inside, low, high = _cells(r, FEW_CELLS if largest else CELLS)
        inside, slack = np.ascontiguousarray(inside.T), 4 * (r.shape[1] + 8) * SINGLE

        def ask(q: Array):
            x = q[:, :, None]
            least = term(x, np.clip(x, low, high)).reshape(len(q), -1)
            left = None if largest else least.astype(np.float32)

            def look(rows: Array, begin: int, end: int, limit: Array) -> Array:
                if largest:
                    beyond = (least[rows] > limit[:, None] * (1 + 1e-12)).astype(np.float32)
                    return beyond @ inside[:, begin:end] < 0.5
                most = limit * (1 + slack) + 1e-30
                return ~(left[rows] @ inside[:, begin:end] > most.astype(np.float32)[:, None])

            return look

        return ask

    return screen


def _hats(r: Array) -> tuple[Array, Array]:
    """KNOTS points of every coordinate (coordinates x points), and by which shares of its two neighbouring points each value
    is made: (rows x coordinates * points), so that a function that is linear between the points becomes a product."""
    some = r[:: max(1, len(r) // 4096)]
    knots = np.quantile(some, np.arange(KNOTS) / (KNOTS - 1), axis=0).T
    knots[:, 0], knots[:, -1] = r.min(axis=0), r.max(axis=0)
    share = np.zeros((*r.shape, KNOTS), dtype=np.float32)
    rows = np.arange(len(r))
    for j in range(r.shape[1]):
        at, part, _ = _between(r[:, j], knots[j])
        share[rows, j, at] = 1 - part
        share[rows, j, at + 1] = part
    return share.reshape(len(r), -1), knots


def _between(x: Array, knots: Array) -> tuple[Array, Array, Array]:
    """The point before each value, the part of the way to the next one, and the length of that way."""
    at = np.clip(np.searchsorted(knots, x, side="right") - 1, 0, KNOTS - 2)
    length = knots[at + 1] - knots[at]
    return at, np.clip(np.divide(x - knots[at], length, out=np.zeros(len(x)), where=length > 0), 0, 1), length


def _gaps(q: Array, knots: Array) -> Array:
    """``|a - t|`` at the points t, lowered beside a so that the lines between the points stay below ``|a - b|``."""
    gaps = np.abs(q[:, :, None] - knots)
    rows = np.arange(len(q))
    for j in range(q.shape[1]):
        at, part, length = _between(q[:, j], knots[j])
        lower = 2 * part * (1 - part) * length
        gaps[rows, j, at] -= lower
        gaps[rows, j, at + 1] -= lower
    return gaps.reshape(len(q), -1)


def _gap_screen(r: Array):
    """Screen for sums of ``|a - b|``: lines between some points, below the sum."""
    shares, knots = _hats(r)
    right, slack = np.ascontiguousarray(shares.T), 8 * (r.shape[1] + 8) * SINGLE
    most = np.abs(knots).max(axis=1).sum()

    def ask(q: Array):
        left = _gaps(q, knots).astype(np.float32)
        room = slack * (np.abs(q).sum(axis=1) + most) + 1e-30

        def look(rows: Array, begin: int, end: int, limit: Array) -> Array:
            reach = (limit + room[rows]) * (1 + slack)
            return ~(left[rows] @ right[:, begin:end] > reach.astype(np.float32)[:, None])

        return look

    return ask


def _bray_curtis_screen(r: Array):
    """Whether the sum of ``|a - b|`` less the limit times ``|a + b|`` can be 0 or less, by lines below every term."""
    shares, knots = _hats(r)
    right, slack = np.ascontiguousarray(shares.T), 8 * (r.shape[1] + 8) * SINGLE
    most = np.abs(knots).max(axis=1).sum()
    mix = np.sqrt(np.arange(2.0, 2.0 + r.shape[1]))
    marks = (r * mix).sum(axis=1)

    def ask(q: Array):
        gaps, sums = _gaps(q, knots), np.abs(q[:, :, None] + knots).reshape(len(q), -1)
        room = slack * (np.abs(q).sum(axis=1) + most) + 1e-30
        opposite = np.isin(-(q * mix).sum(axis=1), marks)  # a + b = 0 counts as equal

        def look(rows: Array, begin: int, end: int, limit: Array) -> Array:
            left = (gaps[rows] - limit[:, None] * sums[rows]).astype(np.float32)
            reach = (1 + limit) * room[rows]
            return ~(left @ right[:, begin:end] > reach.astype(np.float32)[:, None]) | opposite[rows][:, None]

        return look

    return ask


def _same(x: Array) -> Array:
    return x


def _summed(term: Callable[[Array, Array], Array], finish: Callable[[Array], Array] = _same, join=np.add):
    """Distance built coordinate by coordinate, so no (rows x rows x dimensions) array is needed."""

    def pairs(q: Array, r: Array) -> Array:
        total = np.zeros((len(q), len(r)))
        for j in range(q.shape[1]):
            join(total, term(q[:, j, None], r[None, :, j]), out=total)
        return finish(total)

    def bound(q: Array, lo: Array, hi: Array) -> Array:
        # Every term grows with the distance from q, so the closest point of the box is the clipped one.
        total = np.zeros((len(q), len(lo)))
        for j in range(q.shape[1]):
            x = q[:, j, None]
            join(total, term(x, np.clip(x, lo[None, :, j], hi[None, :, j])), out=total)
        return finish(total)

    return pairs, bound


def _square(a: Array, b: Array) -> Array:
    return (a - b) ** 2


def _gap(a: Array, b: Array) -> Array:
    return np.abs(a - b)


def _canberra_term(a: Array, b: Array) -> Array:
    size = np.abs(a) + np.abs(b)
    return np.divide(np.abs(a - b), size, out=np.zeros_like(size), where=size > 0)


def _bray_curtis_pairs(q: Array, r: Array) -> Array:
    num, den = np.zeros((len(q), len(r))), np.zeros((len(q), len(r)))
    for j in range(q.shape[1]):
        a, b = q[:, j, None], r[None, :, j]
        num += np.abs(a - b)
        den += np.abs(a + b)
    return np.divide(num, den, out=np.zeros_like(num), where=den > 0)


def _bray_curtis_rough(a: Array, b: Array) -> Array:
    num, den = np.abs(a - b).sum(axis=1), np.abs(a + b).sum(axis=1)
    return np.divide(num, den, out=np.zeros_like(num), where=den > 0)


_GAP_ROWS, _SUM_ROWS = _by_rows(_gap)[0], _by_rows(lambda a, b: np.abs(a + b))[0]


def _bray_curtis_rows(a: Array, b: Array) -> Array:
    num, den = _GAP_ROWS(a, b), _SUM_ROWS(a, b)
    return np.divide(num, den, out=np.zeros_like(num), where=den > 0)


def _bray_curtis_bound(q: Array, lo: Array, hi: Array) -> Array:
    num, den = np.zeros((len(q), len(lo))), np.zeros((len(q), len(lo)))
    for j in range(q.shape[1]):
        x, a, b = q[:, j, None], lo[None, :, j], hi[None, :, j]
        num += np.abs(x - np.clip(x, a, b))
        den += np.maximum(np.abs(x + a), np.abs(x + b))
    return np.divide(num, den, out=np.zeros_like(num), where=den > 0)


def _unit(x: Array) -> Array:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _centred_unit(x: Array) -> Array:
    return _unit(x - x.mean(axis=1, keepdims=True))


def _angle_pairs(q: Array, r: Array) -> Array:
    return np.clip(1.0 - q @ r.T, 0.0, 2.0)


def _angle_rows(a: Array, b: Array) -> Array:
    return np.clip(1.0 - np.einsum("nd,nd->n", a, b), 0.0, 2.0)


def _angle_bound(q: Array, lo: Array, hi: Array) -> Array:
    reach = np.zeros((len(q), len(lo)))
    for j in range(q.shape[1]):
        x = q[:, j, None]
        reach += np.maximum(x * lo[None, :, j], x * hi[None, :, j])
    return np.clip(1.0 - reach, 0.0, 2.0)


def _as_bits(x: Array) -> Array:
    return (x != 0).astype(float)


def _ratio(num: Array, den: Array) -> Array:
    return np.divide(num, den, out=np.zeros_like(num), where=den > 0)


def _counted(value: Callable[[Array, Array, Array, Array], Array]) -> Metric:
    """Metric over 0/1 vectors from the counts (both set, only q, only r, none).

    Every such distance falls with agreements and rises with disagreements, so a box is bounded by
    its fewest disagreements and its most agreements.
    """

    def pairs(q: Array, r: Array) -> Array:
        both = q @ r.T
        q_only = q.sum(axis=1)[:, None] - both
        r_only = r.sum(axis=1)[None, :] - both
        return value(both, q_only, r_only, q.shape[1] - both - q_only - r_only)

    def bound(q: Array, lo: Array, hi: Array) -> Array:
        most_both, least_q = q @ hi.T, q @ (1 - hi).T
        least_r, most_none = (1 - q) @ lo.T, (1 - q) @ (1 - lo).T
        return value(most_both, least_q, least_r, most_none)

    return Metric(_as_bits, pairs, bound)


def _differs(a: Array, b: Array) -> Array:
    return (a != b).astype(float)


def build_metric(name: str, scale: Array | None = None) -> Metric:
    """The metric by name; ``scale`` is the matrix ``seuclidean`` and ``mahalanobis`` multiply vectors by."""
    if name in ("minkowski", "euclidean", "l2"):
        return Metric(_same, *_summed(_square, np.sqrt), *_by_rows(_square, np.sqrt), _square_screen(np.square))
    if name in ("seuclidean", "mahalanobis"):
        if scale is None:
            raise ValueError(f"{name} needs the spread of the reference rows")
        return Metric(lambda x: x @ scale, *_summed(_square, np.sqrt), *_by_rows(_square, np.sqrt), _square_screen(np.square))
    if name == "sqeuclidean":
        return Metric(_same, *_summed(_square), *_by_rows(_square), _square_screen(_same))
    if name in ("l1", "cityblock", "manhattan"):
        return Metric(_same, *_summed(_gap), *_by_rows(_gap), _gap_screen)
    if name == "chebyshev":
        return Metric(_same, *_summed(_gap, join=np.maximum), *_by_rows(_gap, join=np.maximum), _cell_screen(_gap, largest=True))
    if name == "canberra":
        return Metric(_same, *_summed(_canberra_term), *_by_rows(_canberra_term), _cell_screen(_canberra_term))
    if name == "braycurtis":
        return Metric(_same, _bray_curtis_pairs, _bray_curtis_bound, _bray_curtis_rows, _bray_curtis_rough, _bray_curtis_screen)
    if name == "cosine":
        return Metric(_unit, _angle_pairs, _angle_bound, _angle_rows, None, _angle_screen)
    if name == "correlation":
        return Metric(_centred_unit, _angle_pairs, _angle_bound, _angle_rows, None, _angle_screen)
    if name == "hamming":
        pairs, bound = _summed(_differs)
        return Metric(_same, lambda q, r: pairs(q, r) / q.shape[1], lambda q, a, b: bound(q, a, b) / q.shape[1])
    counted: dict[str, Callable[[Array, Array, Array, Array], Array]] = {
        "matching": lambda tt, tf, ft, ff: _ratio(tf + ft, tt + tf + ft + ff),
        "dice": lambda tt, tf, ft, ff: _ratio(tf + ft, 2 * tt + tf + ft),
        "jaccard": lambda tt, tf, ft, ff: _ratio(tf + ft, tt + tf + ft),
        "rogerstanimoto": lambda tt, tf, ft, ff: _ratio(2 * (tf + ft), tt + ff + 2 * (tf + ft)),
        "sokalmichener": lambda tt, tf, ft, ff: _ratio(2 * (tf + ft), tt + ff + 2 * (tf + ft)),
        "sokalsneath": lambda tt, tf, ft, ff: _ratio(2 * (tf + ft), tt + 2 * (tf + ft)),
        "yule": lambda tt, tf, ft, ff: _ratio(2 * tf * ft, tt * ff + tf * ft),
    }
    if name in counted:
        return _counted(counted[name])
    if name == "russellrao":
        size = Metric(_as_bits, lambda q, r: 1 - q @ r.T / q.shape[1], lambda q, lo, hi: 1 - q @ hi.T / q.shape[1])
        return size
    if name == "kulsinski":
        return Metric(
            _as_bits,
            lambda q, r: _kulsinski(q @ r.T, q.sum(1)[:, None] + r.sum(1)[None, :] - 2 * (q @ r.T), q.shape[1]),
            lambda q, lo, hi: _kulsinski(q @ hi.T, q @ (1 - hi).T + (1 - q) @ lo.T, q.shape[1]),
        )
    raise ValueError(f"unknown metric {name!r}")


def _kulsinski(both: Array, differ: Array, size: int) -> Array:
    return (differ - both + size) / (differ + size)
