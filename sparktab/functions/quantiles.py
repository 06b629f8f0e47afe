"""Exact quantiles without holding a column in one task.

Spark's ``percentile`` keeps every distinct value of the column in one aggregation
buffer. Here a bounded sketch (``percentile_approx``) brackets each wanted rank, a
second pass counts what lies below, on and between the brackets, and only the few
values between them are gathered. If too many lie between, the bracket is narrowed
again. Counts are checked every time, so the sketch steers the work and never the
result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .columns import quoted

SKETCH_ACCURACY = 10_000
GATHER_LIMIT = 20_000
GRID = 1000
MAX_PASSES = 40

# (column, low, high): the open interval a wanted rank lies in or on the edge of.
Bracket = tuple[str, float | None, float | None]


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    accuracy: int = SKETCH_ACCURACY,
    gather_limit: int = GATHER_LIMIT,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of the non-null values of each column.

    All columns share every pass. Two passes suffice up to about
    ``gather_limit * accuracy / 8`` values per column (25 million by default); each
    further pass allows some 200 times more.
    """
    wanted = {c: list(p) for c, p in wanted.items() if len(p)}
    if not wanted:
        return {}
    value = {c: quoted(c).cast("double") for c in wanted}
    df = df.select(*[F.when(~F.isnan(v), v).alias(c) for c, v in value.items()])

    slack = 2.0 / accuracy
    probes = {
        c: sorted({min(1.0, max(0.0, p + s)) for p in probs for s in (-slack, slack)})
        for c, probs in wanted.items()
    }
    first = df.agg(
        *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(wanted)],
        *[
            F.percentile_approx(quoted(c), probes[c], accuracy).alias(f"s{i}")
            for i, c in enumerate(wanted)
        ],
    ).first()
    counts = {c: first[f"n{i}"] for i, c in enumerate(wanted)}

    brackets: dict[Bracket, set[int]] = {}
    expected: dict[Bracket, float] = {}
    for i, (c, probs) in enumerate(wanted.items()):
        if counts[c] == 0:
            continue
        sketch = dict(zip(probes[c], first[f"s{i}"]))
        for p in probs:
            position = p * (counts[c] - 1)
            key = (c, sketch[max(0.0, p - slack)], sketch[min(1.0, p + slack)])
            brackets.setdefault(key, set()).update({math.floor(position), math.ceil(position)})
            expected[key] = counts[c] * 4 * slack

    found: dict[tuple[str, int], float] = {}
    for _ in range(MAX_PASSES):
        if not brackets:
            break
        small = {k: r for k, r in brackets.items() if expected[k] <= gather_limit}
        large = {k: r for k, r in brackets.items() if k not in small}
        brackets, expected = {}, {}
        if large:
            _narrow(df, large, brackets, expected, found, accuracy)
        if small:
            _gather(df, small, brackets, expected, found)
    else:
        raise RuntimeError("quantile brackets did not close")

    result: dict[str, list[float | None]] = {}
    for c, probs in wanted.items():
        result[c] = []
        for p in probs:
            if counts[c] == 0:
                result[c].append(None)
                continue
            position = p * (counts[c] - 1)
            below, above = found[c, math.floor(position)], found[c, math.ceil(position)]
            weight = position - math.floor(position)
            result[c].append(below if weight == 0 else below + (above - below) * weight)
    return result


def _settle(key, ranks, below, at_low, inner, at_high, inside, brackets, expected, found):
    """Place every rank: on an edge, inside (``inside`` decides), or outside after all."""
    c, low, high = key

    def reopen(bracket: Bracket, rank: int, size: float) -> None:
        brackets.setdefault(bracket, set()).add(rank)
        expected[bracket] = size

    for rank in ranks:
        place = rank - below - at_low
        if rank < below:
            reopen((c, None, low), rank, math.inf)
        elif place < 0:
            found[c, rank] = low
        elif place < inner:
            inside(place, rank, reopen)
        elif place < inner + at_high:
            found[c, rank] = high
        else:
            reopen((c, high, None), rank, math.inf)


def _gather(df, small, brackets, expected, found):
    """Settle narrow brackets from one grouped count.

    Every value becomes (column, segment between cut points); only values inside a bracket
    keep their value in the key, so the shuffle carries one row per segment and per
    distinct inner value.
    """
    cuts: dict[str, list[float]] = {}
    for c, low, high in small:
        cuts.setdefault(c, []).extend(x for x in (low, high))
    cuts = {c: sorted(set(points)) for c, points in cuts.items()}
    columns = list(cuts)
    rows = []
    for i, c in enumerate(columns):
        v, points = quoted(c), cuts[c]
        # Even segments are open intervals, odd ones the cut points themselves.
        segment = F.when(v.isNull(), -1)
        for j, point in enumerate(points):
            segment = segment.when(v < point, 2 * j).when(v == point, 2 * j + 1)
        segment = segment.otherwise(2 * len(points))
        wanted = {
            2 * j
            for _, low, high in (k for k in small if k[0] == c)
            for j in range(points.index(low) + 1, points.index(high) + 1)
        }
        rows.append(
            F.struct(
                F.lit(i).alias("c"), segment.alias("s"), v.alias("v"),
                (segment.isin(sorted(wanted)) if wanted else F.lit(False)).alias("w"),
            )
        )
    counted = (
        df.select(F.inline(F.array(*rows)))
        .groupBy("c", "s", F.when(F.col("w"), F.col("v")).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    seen: dict[tuple[str, int], list[tuple[float | None, int]]] = {}
    for r in counted:
        seen.setdefault((columns[r.c], r.s), []).append((r.v, r.n))

    def size(c: str, segments) -> int:
        return sum(n for s in segments for _, n in seen.get((c, s), ()))

    for key, ranks in small.items():
        c, low, high = key
        points = cuts[c]
        first, last = 2 * points.index(low) + 1, 2 * points.index(high) + 1
        middle = range(first + 1, last)
        values = []
        for s in middle:
            point = None if s % 2 == 0 else points[s // 2]
            values += [(v if point is None else point, n) for v, n in seen.get((c, s), ())]
        values.sort()

        def inside(place, rank, reopen, values=values, c=c):
            for v, n in values:
                if place < n:
                    found[c, rank] = v
                    return
                place -= n

        _settle(
            key, ranks, size(c, range(first)), size(c, [first]), size(c, middle),
            size(c, [last]) if last > first else 0, inside, brackets, expected, found,
        )


def _narrow(df, large, brackets, expected, found, accuracy):
    """Settle what lies on the edges of wide brackets and narrow the rest by a sketch grid."""
    grid = [g / GRID for g in range(GRID + 1)]
    exprs = []
    for i, (c, low, high) in enumerate(large):
        v = quoted(c)
        inside = v.isNotNull()
        if low is not None:
            inside = inside & (v > low)
        if high is not None:
            inside = inside & (v < high)
        inner = F.when(inside, v)
        exprs += [
            (F.lit(0) if low is None else F.count_if(v < low)).alias(f"below{i}"),
            (F.lit(0) if low is None else F.count_if(v == low)).alias(f"low{i}"),
            F.count(inner).alias(f"inner{i}"),
            (F.lit(0) if high is None or high == low else F.count_if(v == high)).alias(f"high{i}"),
            F.percentile_approx(inner, grid, accuracy).alias(f"grid{i}"),
        ]
    row = df.agg(*exprs).first()
    for i, (key, ranks) in enumerate(large.items()):
        c, low, high = key
        below, at_low, inner, at_high = (row[f"{k}{i}"] for k in ("below", "low", "inner", "high"))
        points = row[f"grid{i}"]

        def inside(place, rank, reopen, c=c, low=low, high=high, inner=inner, points=points):
            step = GRID * place / max(inner - 1, 1)
            left = math.floor(step - GRID * 2 / accuracy)
            right = math.ceil(step + GRID * 2 / accuracy)
            # The sketch holds the smallest and largest value, so both ends are closed.
            key = (c, points[max(left, 0)], points[min(right, GRID)])
            reopen(key, rank, inner * (right - left + 2) / GRID)

        _settle(key, ranks, below, at_low, inner, at_high, inside, brackets, expected, found)
