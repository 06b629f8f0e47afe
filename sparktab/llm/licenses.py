"""License scans by diagonal voting.

Templates are short phrases and notices. All rolling k-gram hashes of all texts are joined
with the positions where they stand in the templates (k is 2 for phrases, 5 for notices);
text position minus template position is the diagonal of a vote. Votes are counted per
text, template and diagonal, and decide: a phrase needs the votes of all its grams on one
diagonal; of a notice, diagonals a few words apart are merged into one span, which needs a least
share of the notice's grams. What the votes leave is verified word by word: a phrase must stand
there, of a notice at least half of the words must be found in order.

Words are lower-cased runs of letters, digits and non-ASCII characters. A null text has no
words, no places and score 0. Texts that are equal are settled once; all rows are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage, local_table
from .common import keyed_texts, marked_texts, shingle_rows, shingles, small_side

#: Phrases that must stand word for word, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices of public licenses, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "the software is provided as is without warranty of any kind express or implied": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided": "bsd",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
PHRASE_GRAM, NOTICE_GRAM = 2, 5
#: Diagonals at most this far apart belong to one span.
DIAGONAL_GAP = 3
#: Share of a notice's grams that must vote for a span, and of its words that must be found in order.
LEAST_VOTES, LEAST_SHARE = 0.25, 0.5


def template_table(phrases: dict[str, str], notices: dict[str, str]) -> list[tuple[str, str, int]]:
    """(words, label, gram width) of every template."""
    rows = [(text, label, PHRASE_GRAM) for text, label in phrases.items()]
    return rows + [(text, label, min(NOTICE_GRAM, len(text.split()))) for text, label in notices.items()]


def template_grams(spark: SparkSession, templates: list[tuple[str, str, int]]) -> DataFrame:
    """(hash, template, at): where each k-gram stands in the templates."""
    rows = []
    for number, (text, _, width) in enumerate(templates):
        words = text.encode().split()
        values, inside = shingles(words, np.array([len(words)]), (width,))
        grams = values[inside[:, 0], 0].view(np.int64).tolist()
        rows += [(gram, number, at) for at, gram in enumerate(grams)]
    return local_table(spark, rows, "hash bigint, template int, at int")


def votes_needed(templates: list[tuple[str, str, int]], least: float = LEAST_VOTES) -> list[int]:
    """Per template the votes that a diagonal of a phrase, or a merged span of a notice, must have."""
    needed = []
    for text, _, width in templates:
        grams = max(1, len(text.split()) - width + 1)
        needed.append(grams if width == PHRASE_GRAM else max(1, math.ceil(least * grams)))
    return needed


def _verifier(templates: list[tuple[str, str, int]]):
    """Compare the spans of a text with their templates."""
    split = [(text.split(), label, width == PHRASE_GRAM) for text, label, width in templates]
    schema = pa.schema(
        [("k1", pa.int64()), ("k2", pa.int64()),
         ("places", pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64()),
                                        ("share", pa.float64()), ("phrase", pa.bool_())])))]
    )

    def places(words: list[str], span: dict) -> Iterator[dict]:
        wanted, label, phrase = split[span["template"]]
        size = len(wanted)
        if phrase:
            for at in range(max(0, span["low"]), min(span["high"], len(words) - size) + 1):
                if words[at : at + size] == wanted:
                    yield {"label": label, "begin": at, "end": at + size, "share": 1.0, "phrase": True}
            return
        begin, end = max(0, span["low"]), min(len(words), span["high"] + size)
        matcher = SequenceMatcher(None, wanted, words[begin:end], autojunk=False)
        matched = [block for block in matcher.get_matching_blocks() if block.size]
        share = sum(block.size for block in matched) / size
        if share >= LEAST_SHARE:
            last = matched[-1]
            yield {
                "label": label, "begin": begin + matched[0].b, "end": begin + last.b + last.size,
                "share": share, "phrase": False,
            }

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                words = row["words"].split(" ")
                found = [place for span in row["spans"] for place in places(words, span)]
                rows.append({"k1": row["k1"], "k2": row["k2"], "places": found})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return verify


PLACES = "array<struct<label:string,begin:bigint,end:bigint,share:double,phrase:boolean>>"


def find_licenses(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    phrases: dict[str, str] = PHRASES,
    notices: dict[str, str] = NOTICES,
) -> DataFrame:
    """One row per document: its id, n_words, and ``places`` (label, begin, end, share, phrase) by begin."""
    spark = docs.sparkSession
    templates = template_table(phrases, notices)
    widths = tuple(sorted({width for _, _, width in templates}))
    grams = template_grams(spark, templates)  # a few hundred rows, whatever the corpus
    texts = keyed_texts(docs, id_column, text_column)

    votes = shingle_rows(texts, widths).join(F.broadcast(grams), "hash")
    votes = votes.select("k1", "k2", "template", "pos", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
    counted = votes.groupBy("k1", "k2", "template", "diagonal").agg(F.count(F.lit(1)).alias("votes"))
    exact = F.array(*[F.lit(width == PHRASE_GRAM) for _, _, width in templates])[F.col("template")]
    needed = F.array(*[F.lit(n) for n in votes_needed(templates)])[F.col("template")]
    counted = counted.where(~exact | (F.col("votes") >= needed))
    along = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    step = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along), F.lit(0))
    merged = counted.withColumn("group", F.sum((step > DIAGONAL_GAP).cast("int")).over(along)).groupBy(
        "k1", "k2", "template", "group"
    )
    spans = merged.agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"))
    spans = spans.where(F.col("votes") >= needed)
    by_text = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("template", "low", "high")).alias("spans"))

    marked = cut_lineage(marked_texts(texts, grams.select("hash").distinct(), widths))
    worded = marked.where("words IS NOT NULL").dropDuplicates(["k1", "k2"]).select("k1", "k2", "words")
    verified = worded.join(by_text, ["k1", "k2"]).mapInArrow(_verifier(templates), f"k1 bigint, k2 bigint, places {PLACES}")
    by_begin = F.transform("places", lambda p: F.struct(p["begin"], p["end"], p["label"], p["share"], p["phrase"]))
    ordered = F.transform(
        F.sort_array(by_begin),
        lambda p: F.struct(p["label"].alias("label"), p["begin"].alias("begin"), p["end"].alias("end"), p["share"].alias("share"), p["phrase"].alias("phrase")),
    )
    # Rows without a gram of any template, equal ones by the thousand among them, meet nothing.
    places = small_side(verified.select("k1", "k2", ordered.alias("places")))
    met = marked.where("words IS NOT NULL").drop("words").join(places, ["k1", "k2"], "left")
    rest = marked.where("words IS NULL").drop("words").withColumn("places", F.lit(None).cast(PLACES))
    result = met.unionByName(rest)
    return result.select(
        F.col("id").alias(id_column), "n_words", F.coalesce("places", F.array().cast(PLACES)).alias("places")
    )
