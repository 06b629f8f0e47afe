"""Benchmark decontamination: a prefix-filtered set join, then exact containment.

An item's windows are its runs of ``window`` words (a shorter item is one window). A window
occurs in a text only if all its shingles do, so one of them, the prefix for a containment
of 1, has to be joined; the rarest in the corpus gives the fewest candidates.

1. Every shingle of every text is joined with the items' shingles; the matches are written.
2. The matches give each item shingle's number of occurrences, hence each window's rarest
   shingle; a window with a shingle that occurs nowhere is out.
3. A match of a window's rarest shingle places the window in the text. The place must not
   begin before the text (positional bound) nor end after it (length bound).
4. The words at every remaining place are compared with the window's, and the places united.

Words are lower-cased runs of letters, digits and non-ASCII characters. A null text or item
has no words; an item without words has no window; a null item id names no item but its
windows count. Repeated items count once, repeated rows are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import quoted
from ..session import cut_lineage
from .common import PLAIN_WORDS, keyed_texts, marked_texts, shingle_rows, shingles, small_side, text_of, text_pair, word_blocks

#: Words of a shingle; windows shorter than this are one shingle.
SHINGLE = 3

WINDOW_ROWS = "item string, window string, n int, spots array<struct<at:int,hash:bigint>>"


def item_windows(items: DataFrame, item_column: str, text_column: str, window: int, shingle: int) -> DataFrame:
    """One row per item and window: its words, their number, and its shingles with their places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, rows = batch.column("item").to_pylist(), []
            spot = 0
            for counts, words in word_blocks(batch.column("text"), PLAIN_WORDS):
                hashed = {w: shingles(words, counts, (w,))[0][:, 0].view(np.int64) for w in range(1, shingle + 1)}
                ends = np.cumsum(counts)
                for begin, end in zip((ends - counts).tolist(), ends.tolist()):
                    size = min(window, end - begin)
                    width = min(shingle, size)
                    for at in range(begin, end - size + 1) if size else ():
                        spots = [
                            {"at": i, "hash": int(hashed[width][at + i])} for i in range(size - width + 1)
                        ]
                        rows.append((owners[spot], b" ".join(words[at : at + size]).decode(), size, spots))
                    spot += 1
            names = ["item", "window", "n", "spots"]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(names, row)) for row in rows],
                schema=pa.schema(
                    [("item", pa.string()), ("window", pa.string()), ("n", pa.int32()),
                     ("spots", pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.int64())])))]
                ),
            )

    named = items.select(quoted(item_column).cast("string").alias("item"), text_of(text_column).alias("text"))
    return named.mapInArrow(cut, WINDOW_ROWS)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the words at every candidate place; unite the places that hold."""
    schema = pa.schema(
        [("k1", pa.int64()), ("k2", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.string()),
         ("windows", pa.list_(pa.string()))]
    )
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            words = row["words"].split(" ")
            places, found = [], set()
            for place in row["places"]:
                begin, end = place["begin"], place["begin"] + place["n"]
                if end <= len(words) and " ".join(words[begin:end]) == place["window"]:
                    places.append((begin, end))
                    found.add(place["window"])
            spans: list[list[int]] = []
            for begin, end in sorted(places):
                if spans and begin <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([begin, end])
            if spans:
                out.append(
                    {"k1": row["k1"], "k2": row["k2"], "n_hit": sum(e - b for b, e in spans),
                     "spans": ",".join(f"{b}:{e}" for b, e in spans), "windows": sorted(found)}
                )
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def find_benchmark(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = 10,
    shingle: int = SHINGLE,
) -> DataFrame:
    """One row per document: its id, n_words, n_hit, spans of hit words, and the items that occur.

    ``spans`` is ``begin:end`` of the united runs of hit words, comma-joined; ``items`` the
    sorted distinct item ids as strings.
    """
    windows = cut_lineage(item_windows(items, item_column, item_text_column, window, shingle))
    distinct = windows.groupBy("window").agg(F.first("n").alias("n"), F.first("spots").alias("spots"))
    # n is the same and spots are equal for equal words, so any of them will do
    spots = distinct.select("window", "n", F.explode("spots").alias("spot")).select("window", "n", "spot.*")
    sizes = [row.size for row in windows.select(F.least("n", F.lit(shingle)).alias("size")).distinct().collect()]
    widths = tuple(sorted(sizes)) or (shingle,)

    texts = keyed_texts(docs, id_column, text_column)
    wanted = small_side(spots.select("hash").distinct())
    matches = cut_lineage(shingle_rows(texts, widths).join(wanted, "hash"))

    counted = matches.groupBy("hash").agg(F.count(F.lit(1)).alias("rows"))
    ranked = spots.join(counted, "hash", "left").groupBy("window", "n").agg(
        F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "hash", "at")).alias("rarest")
    )
    prefix = ranked.where("rarest.rows > 0").select("window", "n", "rarest.hash", "rarest.at")
    prefix = small_side(prefix)

    marked = cut_lineage(marked_texts(texts, prefix.select("hash").distinct(), widths))
    sized = marked.where("words IS NOT NULL").dropDuplicates(["k1", "k2"]).select("k1", "k2", "n_words", "words")
    begin = (F.col("pos") - F.col("at")).alias("begin")
    placed = matches.join(prefix, "hash").select("k1", "k2", begin, "n", "window").where("begin >= 0").distinct()
    places = placed.groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "n", "window")).alias("places"))
    checked = (
        sized.join(places, ["k1", "k2"])
        .withColumn("places", F.filter("places", lambda p: p["begin"] + p["n"] <= F.col("n_words")))
        .select("k1", "k2", "words", "places")
    )
    schema = "k1 bigint, k2 bigint, n_hit bigint, spans string, windows array<string>"
    verified = cut_lineage(checked.mapInArrow(_verify, schema))
    owners = windows.select("item", "window").where("item IS NOT NULL").distinct()
    owned = verified.select("k1", "k2", F.explode("windows").alias("window")).join(owners, "window")
    lists = owned.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = verified.drop("windows").join(lists, ["k1", "k2"], "left")

    empty: Column = F.array().cast("array<string>")
    return marked.drop("words").join(found, ["k1", "k2"], "left").select(
        F.col("id").alias(id_column),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("items", empty).alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_column: str, text_column: str, **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark window, with all their columns."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = text_of(f"c{names.index(text_column)}")
    keyed = plain.withColumns(dict(zip(("k1", "k2"), text_pair(text))))
    found = find_benchmark(
        keyed.select(F.struct("k1", "k2").alias("doc"), text.alias("text")), items, "doc", "text", **options
    )
    bad = found.where("n_hit > 0").select("doc.k1", "doc.k2").distinct()
    kept = keyed.join(bad, ["k1", "k2"], "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])

