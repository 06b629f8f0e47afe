"""Joins of rows with a table of totals per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .columns import quoted

#: Share of the rows above which a key is joined apart from the others.
HOT_SHARE = 0.001


def joined_by_share(rows: DataFrame, totals: DataFrame, keys: Sequence[str], count: str, support: float = HOT_SHARE) -> DataFrame:
    """Every row with the other columns of its one partner in ``totals``; null keys meet null keys.

    The column ``count`` of ``totals`` tells how many rows a key has. The few keys (at most
    1 / support) that hold more than ``support`` of all rows are broadcast, so no task gets all
    rows of a hot key; the others meet in one shuffle. Rows are read twice: write them first.
    """
    marked = {k: f"__join_{i}" for i, k in enumerate(keys)}
    partners = cut_lineage(totals.withColumnsRenamed(marked))
    least = (partners.agg(F.sum(quoted(count)).alias("n")).first().n or 0) * support
    same = [quoted(k).eqNullSafe(F.col(m)) for k, m in marked.items()]
    hot = F.broadcast(partners.where(quoted(count) > least))
    rest = rows.join(hot, same, "left_anti").join(partners.where(quoted(count) <= least), same)
    return rows.join(hot, same).unionByName(rest).drop(*marked.values())
