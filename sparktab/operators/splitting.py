"""Exact random and stratified train/validation/test splits."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import quoted, require_columns
from ..functions.ranking import SharedKeysError, order_keys, rank_cuts
from ..session import cut_lineage, local_table
from .labels import split_label_kind
from .strata import split_in_classes

# Accepted ratio ranges (test, validation) per caller.
RATIO_LIMITS = {
    "table": ((0.1, 0.3), (0.1, 0.5)),
    "script": ((0.1, 0.3), (0.1, 0.3)),
    "request": ((0.1, 0.5), (0.0, 0.4)),
}
MAX_TOGETHER = 0.9
MIN_CLASS_ROWS = 5
MIN_TABLE_ROWS = 10
#: Classes whose quotas the driver works out; more of them are shared out on Spark.
MAX_STRATA = 10_000


def check_ratios(test_size: float, val_size: float, limits: str = "table") -> None:
    """Raise unless both shares lie in the ranges of the named limits."""
    (test_low, test_high), (val_low, val_high) = RATIO_LIMITS[limits]
    if not test_low <= test_size <= test_high:
        raise ValueError(f"test share must be within {test_low}..{test_high}")
    if not val_low <= val_size <= val_high:
        raise ValueError(f"validation share must be within {val_low}..{val_high}")
    if test_size + val_size >= MAX_TOGETHER:
        raise ValueError(f"test and validation shares must stay below {MAX_TOGETHER} together")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """``(label, n)`` over all rows, nulls included."""
    return df.groupBy(quoted(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def stratify_check(df: DataFrame, label: str, min_rows: int = MIN_CLASS_ROWS) -> DataFrame:
    """One row: classes, smallest class, and whether a stratified split is possible."""
    counts = class_counts(df, label).where("label IS NOT NULL")
    return counts.agg(
        F.count(F.lit(1)).alias("classes"),
        F.min("n").alias("smallest_class"),
        ((F.count(F.lit(1)) > 1) & (F.min("n") >= min_rows)).alias("eligible"),
    )


def require_stratifiable(df: DataFrame, label: str) -> bool:
    """The strict rule: False for a continuous label, else raise unless every class fits.

    A label of one class, of a non-whole number type, or with a class under five rows is
    refused instead of quietly falling back to a random split.
    """
    if split_label_kind(df, label) != "class":
        return False
    facts = stratify_check(df, label).first()
    if facts.classes < 2:
        raise ValueError(f"label {label} has one class only and cannot be stratified")
    if facts.smallest_class < MIN_CLASS_ROWS:
        raise ValueError(f"label {label} has a class of {facts.smallest_class} rows, need {MIN_CLASS_ROWS}")
    return True


def largest_remainder(counts: Mapping[Any, int], total: int) -> dict[Any, int]:
    """Share ``total`` over the classes by size: floors first, then largest remainders.

    Equal remainders go to the class that comes first in sorted order. Whole-number
    arithmetic, so no rounding can tip a remainder.
    """
    everything = sum(counts.values())
    order = sorted(counts, key=lambda c: (c is None, c))
    quota = {c: counts[c] * total // everything for c in order}
    left = total - sum(quota.values())
    by_remainder = sorted(order, key=lambda c: -(counts[c] * total % everything))
    for c in by_remainder[:left]:
        quota[c] += 1
    return quota


def _sizes(n: int, test_size: float, val_size: float) -> tuple[int, int]:
    """Exact test and validation row counts of ``n`` rows."""
    test = math.ceil(test_size * n)
    rest = n - test
    val = 0 if rest < 2 else math.ceil(rest * (val_size / (1 - test_size)))
    return test, val


def _quotas(counts: Mapping[Any, int], test: int, val: int) -> dict[Any, tuple[int, int]]:
    """Per class: rows for test, rows for validation."""
    n = sum(counts.values())
    kept = largest_remainder(counts, n - test)
    train = largest_remainder(kept, n - test - val) if val else kept
    return {c: (counts[c] - kept[c], kept[c] - train[c]) for c in counts}


def _cut(
    df: DataFrame,
    strata: str | None,
    quotas: Mapping[Any, Sequence[int]],
    names: Sequence[str],
    otherwise: str,
    out: str,
    narrow: DataFrame | None = None,
) -> DataFrame:
    """Assign ``names`` to the first rows of each stratum in key order.

    Rows are compared with the keys of the cut rows, so no row is moved; only counts are
    shuffled to find the cuts. ``narrow`` holds the stratum and the two keys of the same
    rows, where these are cheaper to read than the rows themselves.
    """
    group = strata or "__all"
    data = df if strata else df.withColumn("__all", F.lit(0))
    ranked = data if narrow is None else narrow if strata else narrow.withColumn("__all", F.lit(0))
    cumulative = {}
    for g, q in quotas.items():
        total, ranks = 0, []
        for size in q:
            total += size
            ranks.append(total)
        cumulative[g] = ranks
    cuts = rank_cuts(ranked, group, "__k1", "__k2", cumulative)
    rows = []
    for g, found in cuts.items():
        flat: list[int | None] = []
        for cut in found:
            flat += list(cut) if cut else [None, None]
        rows.append((g, *flat))
    spots = ", ".join(f"__a{i} bigint, __b{i} bigint" for i in range(len(names)))
    if strata:
        kind = data.schema[strata].dataType.simpleString()
        table = local_table(df.sparkSession, rows, f"__g {kind}, {spots}")
        data = data.join(F.broadcast(table), quoted(strata).eqNullSafe(F.col("__g")), "left")
        limit = {f"__{k}{i}": F.col(f"__{k}{i}") for k in "ab" for i in range(len(names))}
    else:
        values = rows[0][1:] if rows else [None] * (2 * len(names))
        limit = {
            f"__{k}{i}": F.lit(values[2 * i + j]).cast("bigint")
            for j, k in enumerate("ab")
            for i in range(len(names))
        }
    k1, k2 = F.col("__k1"), F.col("__k2")
    assigned = None
    for i, name in enumerate(names):
        a, b = limit[f"__a{i}"], limit[f"__b{i}"]
        test = (k1 < a) | ((k1 == a) & (k2 <= b))
        assigned = F.when(test, name) if assigned is None else assigned.when(test, name)
    return data.withColumn(out, assigned.otherwise(otherwise)).select(*df.columns, out)


def _cut_or_tell_apart(
    df: DataFrame, keyed: DataFrame, strata: str | None, quotas: Mapping[Any, Sequence[int]], names: Sequence[str],
    otherwise: str, out: str, seed: int, narrow: DataFrame | None = None,
) -> DataFrame:
    """Cut by the keys given; if rows that share one lie across a cut, by a hash of their whole rows too.

    The second form is written, since its comparisons read every column.
    """
    try:
        return _cut(keyed, strata, quotas, names, otherwise, out, narrow).drop("__k1", "__k2")
    except SharedKeysError:
        apart = keyed.withColumn("__k2", order_keys(list(df.columns), seed)[1])
        return cut_lineage(_cut(apart, strata, quotas, names, otherwise, out).drop("__k1", "__k2"))


def split_table(
    df: DataFrame,
    label: str | None = None,
    test_size: float = 0.2,
    val_size: float = 0.2,
    stratified: bool = True,
    seed: int = 42,
    key: Sequence[str] | None = None,
    dedup: bool = True,
    portable_keys: bool = False,
    limits: str = "table",
    out: str = "split",
    min_class_rows: int = MIN_CLASS_ROWS,
) -> DataFrame:
    """Add a ``split`` column with exact sizes: train, val, test.

    The test part has ``ceil(n * test_size)`` rows; the validation share is taken from
    the rest, rescaled by ``1 / (1 - test_size)``. A stratified split shares both sizes
    over the classes by largest remainder and falls back to a random one if a class has
    under ``min_class_rows`` rows. Rows are ordered by a seeded hash of ``key`` (by default the whole
    row); rows that share it by a hash of the whole row, so sizes are exact for any key as
    long as rows differ. Equal rows are removed first, or refused where a cut meets them.
    """
    check_ratios(test_size, val_size, limits)
    if key is None and not dedup:
        raise ValueError("without removing repeated rows a unique key is needed")
    if key is not None:
        require_columns(df, key)
    if dedup and key is not None:
        df = cut_lineage(df.dropDuplicates())  # once, for the counts, the cuts and the result
        dedup = False
    k1, k2 = order_keys(list(key or df.columns), seed, portable_keys)
    keyed = df.withColumns({"__k1": k1, "__k2": k2})
    strata = label if stratified and label is not None else None
    narrow = keyed.select(*([quoted(strata)] if strata else []), "__k1", "__k2")
    if dedup:
        # Equal rows have equal keys: counting needs the keys only, and the whole rows go
        # through one shuffle, in the result.
        narrow = narrow.distinct()
        keyed = df.dropDuplicates().withColumns({"__k1": k1, "__k2": k2})
    counts: dict[Any, int] = {}
    if strata is not None:
        sizes = cut_lineage(class_counts(narrow, strata))
        rows = sizes.limit(MAX_STRATA + 1).collect()
        if len(rows) > MAX_STRATA:
            facts = sizes.agg(F.sum("n").alias("n"), F.min(F.when(F.col("label").isNotNull(), F.col("n"))).alias("least")).first()
            if facts.least >= min_class_rows:
                return _split_many(keyed, strata, facts.n, test_size, val_size, seed, key, out)
            strata, rows = None, []
        counts = {r.label: r.n for r in rows}
        if min((n for c, n in counts.items() if c is not None), default=0) < min_class_rows:
            strata = None
    n = sum(counts.values()) if counts else narrow.count()
    if n == 0:
        raise ValueError("no rows left to split")
    test, val = _sizes(n, test_size, val_size)
    if n - test - val <= 0:
        raise ValueError("the train part would be empty")
    quotas = _quotas(counts, test, val) if strata else {0: (test, val)}
    done = _cut_or_tell_apart(df, keyed, strata, quotas, ["test", "val"], "train", out, seed, narrow)
    if val == 0 and n - test > 5:
        return repair_splits(done, label if strata else None, seed, key, out)
    return done


def _split_many(
    keyed: DataFrame, label: str, n: int, test_size: float, val_size: float, seed: int, key: Sequence[str] | None, out: str
) -> DataFrame:
    """The split by a label of very many classes; rows that share a key are told apart by all their columns."""
    test, val = _sizes(n, test_size, val_size)
    if n - test - val <= 0:
        raise ValueError("the train part would be empty")
    own = [c for c in keyed.columns if c not in ("__k1", "__k2")]
    if key is not None:
        keyed = keyed.withColumn("__k3", order_keys(own, seed)[1]).withColumn("__k2", F.struct("__k2", "__k3")).drop("__k3")
    done = split_in_classes(keyed, label, test, val, "__k1", "__k2", out).select(*[quoted(c) for c in own], out)
    if val == 0 and n - test > 5:
        return repair_splits(done, label, seed, key, out)
    return done


def repair_splits(
    df: DataFrame, label: str | None = None, seed: int = 42, key: Sequence[str] | None = None,
    out: str = "split",
) -> DataFrame:
    """Refill an empty test or validation part of an already split table.

    An empty test part: all rows are pooled, 10 % become test and 20 % of the rest
    validation. An empty validation part: 10 % of more than five train rows. An empty
    train part is an error.
    """
    sizes = {r[out]: r["n"] for r in df.groupBy(out).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get("train"):
        raise ValueError("the train part is empty")
    if not sizes.get("test"):
        df = _carve(df, ["train", "val"], [("test", 0.1), ("val", 0.2)], label, seed, key, out)
        sizes = {r[out]: r["n"] for r in df.groupBy(out).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get("val") and sizes.get("train", 0) > 5:
        df = _carve(df, ["train"], [("val", 0.1)], label, seed, key, out)
    return df


def _carve(df, pool, parts, label, seed, key, out):
    """Re-assign the rows of ``pool``: each part takes its share of what is left."""
    inside = quoted(out).isin(pool)
    pooled = df.where(inside).drop(out)
    k1, k2 = order_keys(list(key or pooled.columns), seed)
    if label:
        rows = class_counts(pooled, label).limit(MAX_STRATA + 1).collect()
        if len(rows) > MAX_STRATA:
            return _carve_many(pooled.withColumns({"__k1": k1, "__k2": k2}), parts, label, out).unionByName(df.where(~inside))
    counts = {r.label: r.n for r in rows} if label else {0: pooled.count()}
    taken, left = [], dict(counts)
    for _, share in parts:
        total = sum(left.values())
        kept = largest_remainder(left, total - math.ceil(total * share))
        taken.append({c: left[c] - kept[c] for c in left})
        left = kept
    quotas = {c: [t[c] for t in taken] for c in counts}
    keyed = pooled.withColumns({"__k1": k1, "__k2": k2})
    strata = label if label and len(counts) > 1 and sum(counts.values()) > 10 else None
    if strata is None:
        quotas = {0: [sum(t.values()) for t in taken]}
    again = _cut_or_tell_apart(pooled, keyed, strata, quotas, [name for name, _ in parts], "train", out, seed)
    return again.unionByName(df.where(~inside))


def _carve_many(keyed: DataFrame, parts: Sequence[tuple[str, float]], label: str, out: str) -> DataFrame:
    """The same for a label of very many classes: test and validation rows, or validation rows alone."""
    n = keyed.count()
    sizes = {}
    for name, share in parts:
        sizes[name] = math.ceil((n - sum(sizes.values())) * share)
    done = split_in_classes(keyed, label, sizes.get("test", 0), sizes["val"], "__k1", "__k2", out)
    return done.drop("__k1", "__k2")


def split_summary(df: DataFrame, label: str | None = None, split: str = "split") -> DataFrame:
    """Per split (and class): rows and share of all rows."""
    groups = [quoted(split).alias("split")] + ([quoted(label).alias("label")] if label else [])
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total")).withColumn("__k", F.lit(1))
    return (
        counts.withColumn("__k", F.lit(1))
        .join(F.broadcast(total), "__k")
        .withColumn("ratio", F.col("n") / F.col("__total"))
        .drop("__k", "__total")
    )
