"""Global ranks, running sums and rank cuts without a single-task sort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, local_table
from .columns import quoted

GATHER_LIMIT = 10_000
DRIVER_CELLS = 1_000_000


SHARED_KEYS = "rows that agree in every column of the key share a cut; remove repeated rows or name a unique key"


class SharedKeysError(ValueError):
    """Rows that share both keys lie on either side of a cut."""


def order_keys(columns: Sequence[str], seed: int, portable: bool = False) -> tuple[Column, Column]:
    """Two independent pseudo-random bigints per row, from key columns and a seed.

    ``portable=True`` derives them from an MD5 text so that any SQL engine can repeat
    the order; the default is the much cheaper 64-bit xxHash.
    """
    if portable:
        text = F.md5(F.concat_ws("|", F.lit(str(seed)), *[quoted(c).cast("string") for c in columns]))
        return (
            F.conv(F.substring(text, 1, 15), 16, 10).cast("bigint"),
            F.conv(F.substring(text, 16, 15), 16, 10).cast("bigint"),
        )
    keys = [quoted(c) for c in columns]
    return F.xxhash64(F.lit(seed), *keys), F.xxhash64(F.lit(~seed), *keys)


def rank_cuts(
    df: DataFrame, group: str, first_key: str, second_key: str, quotas: Mapping[Any, Sequence[int]], shared: bool = False
) -> dict[Any, list[tuple[int, int] | None]]:
    """Per group, the (first_key, second_key) of the q-th smallest row for each quota q.

    Radix selection: count rows per group and leading key bits, keep the one bucket
    that holds the cut, repeat on the next bits until a bucket is small enough to look
    at. Only counts are shuffled, however large a single group is. ``None`` for q = 0.

    Where more rows than that share the first key, the second is searched in the same way.
    Each cut pair must belong to one row, else no comparison could take exactly q rows: a
    row that shares both keys with the next one after the cut is an error. With ``shared`` its
    pair is the cut all the same, so that rows up to the cut are more than q.
    """
    bits = 12
    while bits > 4 and (1 << bits) * max(len(quotas), 1) > DRIVER_CELLS:
        bits -= 1
    pending: dict[Any, dict[int, tuple[int | None, int]]] = {}
    result: dict[Any, list[tuple[int, int] | None]] = {}
    for g, qs in quotas.items():
        result[g] = [None] * len(qs)
        pending[g] = {i: (None, q) for i, q in enumerate(qs) if q > 0}
    pending = {g: p for g, p in pending.items() if p}
    few = max(1, min(GATHER_LIMIT, DRIVER_CELLS // max(1, sum(len(p) for p in pending.values()))))
    shift = 64
    g_col, k1, k2 = quoted(group), quoted(first_key), quoted(second_key)
    spark = df.sparkSession
    group_type = df.schema[group].dataType.simpleString()

    while pending:
        scope = df
        if shift < 64:
            buckets = sorted(
                {(g, prefix) for g, p in pending.items() for prefix, _ in p.values()}, key=str
            )
            table = local_table(spark, list(buckets), f"__g {group_type}, __p bigint")
            scope = df.join(
                F.broadcast(table),
                g_col.eqNullSafe(F.col("__g")) & (F.shiftright(k1, shift) == F.col("__p")),
                "left_semi",
            )
        next_shift = max(shift - bits, 0)
        counts: dict[Any, list[tuple[int, int]]] = {}
        for row in (
            scope.groupBy(g_col.alias("g"), F.shiftright(k1, next_shift).alias("p"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        ):
            counts.setdefault(row.g, []).append((row.p, row.n))
        small: dict[tuple[Any, int], list[tuple[int, int]]] = {}
        following: dict[Any, dict[int, tuple[int | None, int]]] = {}
        for g, cuts_left in pending.items():
            ordered = sorted(counts.get(g, []))
            for i, (prefix, rank) in cuts_left.items():
                low = None if prefix is None else prefix << (shift - next_shift)
                high = None if prefix is None else (prefix + 1) << (shift - next_shift)
                for p, n in ordered:
                    if low is not None and not low <= p < high:
                        continue
                    if rank <= n:
                        if n <= few:
                            small.setdefault((g, p), []).append((i, rank))
                        elif next_shift == 0:
                            same = df.where(g_col.eqNullSafe(F.lit(g)) & (k1 == p))
                            result[g][i] = _second_cut(same, group, first_key, second_key, g, p, rank, shared)
                        else:
                            following.setdefault(g, {})[i] = (p, rank)
                        break
                    rank -= n
                else:
                    raise ValueError(f"group {g!r} has fewer rows than its quota")
        if small:
            table = local_table(spark, sorted(small, key=str), f"__g {group_type}, __p bigint")
            members: dict[tuple[Any, int], list[tuple[int, int]]] = {}
            for row in (
                scope.join(
                    F.broadcast(table),
                    g_col.eqNullSafe(F.col("__g")) & (F.shiftright(k1, next_shift) == F.col("__p")),
                )
                .select(F.col("__g").alias("g"), F.col("__p").alias("p"), k1.alias("a"), k2.alias("b"))
                .collect()
            ):
                members.setdefault((row.g, row.p), []).append((row.a, row.b))
            for (g, p), wanted in small.items():
                ordered_rows = sorted(members[g, p])
                for i, rank in wanted:
                    result[g][i] = ordered_rows[rank - 1]
                    if not shared and ordered_rows[rank - 1 : rank] == ordered_rows[rank : rank + 1]:
                        raise SharedKeysError(SHARED_KEYS)
        pending, shift = following, next_shift
    return result


def _second_cut(
    rows: DataFrame, group: str, first_key: str, second_key: str, g: Any, first: int, rank: int, shared: bool
) -> tuple[int, int]:
    """The cut among rows of one first key, searched by the second."""
    spread = rows.agg(F.min(quoted(second_key)).alias("a"), F.max(quoted(second_key)).alias("b")).first()
    if spread.a == spread.b:
        if not shared:
            raise SharedKeysError(SHARED_KEYS)
        return first, spread.a
    return first, rank_cuts(rows, group, second_key, first_key, {g: [rank]}, shared)[g][0][0]


def running_totals(
    df: DataFrame, order: Sequence[Column], totals: Mapping[str, Column]
) -> DataFrame:
    """Add running sums over a global order, ``{new column: summed expression}``.

    The rows are range-partitioned by the order and written to the checkpoint folder
    together with their partition number; one total per partition is carried over as an
    offset and the running sum itself is computed inside each partition. The order must
    not leave ties (aggregate equal keys first). An unpartitioned window would sort the
    whole table in one task.
    """
    parts = cut_lineage(
        df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    )
    sums = parts.groupBy("__part").agg(*[F.sum(e).alias(n) for n, e in totals.items()])
    offsets, carried = [], [0] * len(totals)
    for row in sorted(sums.collect(), key=lambda r: r["__part"]):
        offsets.append((row["__part"], *carried))
        carried = [a + (row[n] or 0) for a, n in zip(carried, totals)]
    types = {f.name: f.dataType.simpleString() for f in sums.schema}
    ddl = ", ".join(["__part int", *[f"`__off_{n}` {types[n]}" for n in totals]])
    inside = (
        Window.partitionBy("__part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    if len(offsets) <= 1:
        return parts.withColumns({n: F.sum(e).over(inside) for n, e in totals.items()}).drop("__part")
    return (
        parts.withColumns({n: F.sum(e).over(inside) for n, e in totals.items()})
        .join(F.broadcast(local_table(df.sparkSession, offsets, ddl)), "__part")
        .withColumns({n: F.col(n) + F.col(f"__off_{n}") for n in totals})
        .drop("__part", *[f"__off_{n}" for n in totals])
    )


def ranked_dictionary(df: DataFrame, column: str) -> DataFrame:
    """``(value, code, share)``: codes 0..k-1 in sorted order, for any number of values.

    ``share`` is the part of the non-null rows that hold the value.
    """
    counted = (
        df.select(quoted(column).alias("value"))
        .where("value IS NOT NULL")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    ranked = running_totals(
        counted, [F.col("value").asc()], {"code": F.lit(1).cast("bigint"), "__upto": F.col("__n")}
    )
    total = ranked.agg(F.max("__upto").alias("n")).first().n or 1
    return ranked.select("value", (F.col("code") - 1).alias("code"), (F.col("__n") / total).alias("share"))
