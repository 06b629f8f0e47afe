"""All-against-all work between two tables, in bounded blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .columns import quoted

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 50_000
BLOCK_BYTES = 64 << 20

Kernel = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def against_all(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    kernel: Kernel,
    schema: str,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, bool]:
    """Run ``kernel(left rows, right rows)`` so that each left row meets each right row.

    If ``right`` is measured to be small it is broadcast and ``left`` is streamed past it
    without a shuffle; the kernel then sees the whole right side at once. Otherwise both
    sides are cut by a hash of their keys into blocks of about ``block_rows`` rows, fewer
    for wide rows (a block holds at most about BLOCK_BYTES of numbers), and every pair of blocks is one group of bounded size, however skewed the values are.
    Returns the result and whether a left row may occur several times (once per right
    block) and has to be merged; kernels reduce inside a block, so only reduced rows
    are shuffled again.
    """
    right_count = right.count()
    if right_count * len(right.columns) * 8 <= broadcast_bytes:
        shared = left.sparkSession.sparkContext.broadcast(right.toArrow().to_pandas())

        def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield kernel(batch, shared.value)

        return left.mapInPandas(stream, schema), False

    widest = max(len(left.columns), len(right.columns))
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * widest)))
    left_blocks = max(1, math.ceil(left.count() / block_rows))
    right_blocks = max(1, math.ceil(right_count / block_rows))

    def cut(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        spread = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
        return spread.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    # Fresh column identities, so that a table can meet itself.
    right = right.select(*[quoted(c).alias(c) for c in right.columns])
    lefts = cut(left, left_key, "__l", left_blocks, "__r", right_blocks)
    rights = cut(right, right_key, "__r", right_blocks, "__l", left_blocks)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        return kernel(a.drop(columns=["__l", "__r"]), b.drop(columns=["__l", "__r"]))

    paired = (
        lefts.groupBy("__l", "__r").cogroup(rights.groupBy("__l", "__r")).applyInPandas(meet, schema)
    )
    return paired, right_blocks > 1
