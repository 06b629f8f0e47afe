"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks (see ``tags``). Every block becomes a vector: its path of
elements and class, id and role words, hashed; its words, hashed; and a few numbers (length,
share of links, punctuation, place on the page). A bidirectional LSTM reads the sequence, so
that each block is labelled in the light of the whole page. The blocks labelled main, joined
by line ends, are the text.

The labeller is trained from a bounded sample of pages, drawn by hash from those of up to
SAMPLE_BLOCKS blocks and used whole. Their blocks are labelled by where they stand: inside an article or main element, but not in what an article carries along
(menus, forms, comments and so on). Each sample page is used as it is and twice with its
paragraphs and boilerplate put into containers that the sample may lack. Pages without such
elements are read but do not train. A few pages of fixed sentences in all known containers
train along, alone if the sample has no labelled page.

Every block of every page is read; nothing is capped. A null page equals an empty one and
has the empty text. Repeated rows are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import quoted
from . import lstm
from .common import blocks, text_of
from .tags import Block, leaf_blocks

#: Pages of the training sample, and most blocks of a page that may be drawn; chosen pages are used whole.
SAMPLE_PAGES, SAMPLE_BLOCKS = 500, 400
#: Hash buckets of path parts and of words; numbers beside them.
PATH_BUCKETS, WORD_BUCKETS, NUMBERS = 256, 32, 6
INPUTS = PATH_BUCKETS + WORD_BUCKETS + NUMBERS
EPOCHS, RATE = 6, 0.01
#: Pages of fixed sentences that train along.
FIXED_PAGES = 400
#: Bytes of pages parsed and labelled together.
PAGE_BLOCK = 1_000_000

#: Elements, and words of class, id or role, that hold main text or boilerplate.
MAIN_PARTS = frozenset(["article", "main", ".article", ".main", ".post", ".entry", ".story"])
OTHER_ELEMENTS = frozenset("nav header footer aside form menu dialog button".split())
OTHER_NAMES = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner sidebar side menu nav navigation navbar breadcrumb "
    "breadcrumbs header masthead footer comment comments reply replies discussion disqus notice alert cookie cookies "
    "consent gdpr popup modal overlay share sharing social related recommended newsletter subscribe signup login form "
    "search widget toolbar pagination copyright complementary contentinfo".split()
)
#: Containers for training pages, as paths below the body.
MAIN_PATHS = (("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post"), ("section", ".article"))
OTHER_PATHS = (
    ("nav", "ul", "li"), ("header",), ("footer",), ("aside",), ("form",), ("div", ".ad"), ("div", ".advert"),
    ("div", ".sidebar"), ("div", ".menu", "ul", "li"), ("div", ".cookie", ".notice"), ("div", ".notice"),
    ("section", ".comments"), ("div", ".comment"), ("ul", ".comments", "li"), ("div", ".share"), ("div", ".related"),
    ("div", ".newsletter"), ("div", ".banner"), ("div", ".footer"), ("div", ".header"), ("div", ".popup"),
)
LEAVES = (
    ("p",), ("p",), ("p",), ("h1",), ("h2",), ("h3",), ("ul", "li"), ("ol", "li"), ("blockquote",), ("blockquote", "p"),
    ("table", "tr", "td"), ("pre",), ("dl", "dd"), ("figure", "figcaption"), ("div",), ("div", "p"), ("section", "p"),
)
FIXED_SENTENCES = (
    "The council met on Monday and agreed to repair the old bridge before winter.",
    "Nobody had expected the river to rise so quickly, the mayor said after the meeting.",
    "Work begins in the spring and is to take no longer than two years.",
)


def bucket(part: str, buckets: int) -> int:
    return xxhash.xxh64_intdigest(part.encode()) % buckets


Path = tuple[str, ...]


def rule_labels(paths: list[Path]) -> np.ndarray | None:
    """1 main, 0 other, by the elements above each block; None for a page without a main element."""
    labels = np.zeros(len(paths), np.int8)
    seen = False
    for i, path in enumerate(paths):
        spots = [k for k, part in enumerate(path) if part in MAIN_PARTS]
        if spots:
            seen = True
            inner = path[spots[0] + 1 :]
            labels[i] = not any(
                part in OTHER_ELEMENTS or part[0] == "." and part[1:] in OTHER_NAMES for part in inner
            )
    return labels if seen else None


class Vectors:
    """Block vectors; hashes of parts and words are remembered."""

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        if path not in self.paths:
            if len(self.paths) > 20_000:
                self.paths.clear()
            row = np.zeros(PATH_BUCKETS, np.float32)
            for depth, part in enumerate(path[::-1]):
                row[bucket(part, PATH_BUCKETS)] += 1.0
                if not depth:
                    row[bucket("leaf " + part, PATH_BUCKETS)] += 1.0
            self.paths[path] = row
        return self.paths[path]

    def page(self, page: list[Block]) -> np.ndarray:
        return self.joined([block.path for block in page], self.content(page))

    def joined(self, paths: list[Path], content: np.ndarray) -> np.ndarray:
        rows = np.zeros((len(paths), INPUTS), np.float32)
        for i, path in enumerate(paths):
            rows[i, :PATH_BUCKETS] = self.path(path)
        rows[:, PATH_BUCKETS:] = content
        return rows

    def content(self, page: list[Block]) -> np.ndarray:
        """What of the vectors depends on text and place."""
        rows = np.zeros((len(page), WORD_BUCKETS + NUMBERS), np.float32)
        known = self.words
        if len(known) > 500_000:
            known.clear()
        for i, block in enumerate(page):
            words = block.text.lower().split()
            codes = []
            for word in words:
                code = known.get(word)
                if code is None:
                    code = known[word] = bucket(word, WORD_BUCKETS)
                codes.append(code)
            counts = np.bincount(codes, minlength=WORD_BUCKETS)
            rows[i, :WORD_BUCKETS] = counts / len(words)
            size = len(block.text)
            rows[i, WORD_BUCKETS:] = (
                np.log1p(size) / 5,
                np.log1p(len(words)) / 4,
                block.link_chars / size,
                (block.text.count(".") + block.text.count(",")) / len(words),
                i / len(page),
                (len(page) - i) / len(page),
            )
        return rows


def _some(rng: np.random.Generator, paths: tuple) -> tuple[str, ...]:
    return paths[rng.integers(len(paths))]


def _other_path(rng: np.random.Generator, main: tuple[str, ...]) -> tuple[str, ...]:
    """A boilerplate container, sometimes within the main one, with or without an element below it."""
    inside = main if rng.random() < 0.4 else ()
    return (*inside, *_some(rng, OTHER_PATHS), *(_some(rng, LEAVES) if rng.random() < 0.6 else ()))


def varied(labels: np.ndarray, seed: int) -> list[Path]:
    """Paths for a page with its main blocks in one main container and every run of others in some other one."""
    rng = np.random.default_rng(seed)
    main = _some(rng, MAIN_PATHS)
    out, other = [], _other_path(rng, main)
    for wanted in labels:
        if wanted:
            path = (*main, *_some(rng, LEAVES))
        elif rng.random() < 0.5:
            path = other = _other_path(rng, main)
        else:
            path = other
        out.append(("html", "body", *path))
    return out


def fixed_pages(number: int) -> Iterator[tuple[list[Block], np.ndarray]]:
    """Small labelled pages of fixed sentences, for the containers that a sample may lack."""
    for seed in range(number):
        rng = np.random.default_rng(seed)
        kinds = [0] * rng.integers(0, 5) + [1] * rng.integers(1, 6)
        for _ in range(rng.integers(0, 4)):
            kinds.insert(rng.integers(len(kinds) + 1), 0)
        kinds += [1] * rng.integers(0, 4) + [0] * rng.integers(0, 6)
        labels = np.array(kinds, np.int8)
        texts = [_some(rng, FIXED_SENTENCES)[: rng.integers(10, 90)] for _ in kinds]
        page = [Block((), text, len(text) if not kind and rng.random() < 0.4 else 0) for text, kind in zip(texts, kinds)]
        yield [block._replace(path=path) for block, path in zip(page, varied(labels, seed))], labels


def train_labeller(samples: list[tuple[list[Path], np.ndarray]]) -> lstm.Parameters:
    """The labeller for sampled pages (paths and content of their blocks)."""
    vectors, sequences, targets = Vectors(), [], []

    def add(paths: list[Path], content: np.ndarray, labels: np.ndarray) -> None:
        sequences.append(vectors.joined(paths, content))
        targets.append(labels)

    for page, labels in fixed_pages(FIXED_PAGES):
        add([block.path for block in page], vectors.content(page), labels)
    for n, (paths, content) in enumerate(samples):
        labels = rule_labels(paths)
        if labels is not None:
            add(paths, content, labels)
            add(varied(labels, 2 * n), content, labels)
            add(varied(labels, 2 * n + 1), content, labels)
    return lstm.train(lstm.first_parameters(INPUTS), sequences, targets, EPOCHS, RATE)


def sample_pages(pages: DataFrame, size: int) -> list[tuple[list[Path], np.ndarray]]:
    """Paths and content vectors of the ``size`` pages of 1 to SAMPLE_BLOCKS blocks whose hashes are smallest.

    Pages are parsed where they lie; what comes back is bounded by pages and blocks.
    """

    def sizes(htmls: pa.Array) -> pa.Array:
        return pa.array([len(leaf_blocks(html)) for html in htmls.to_pylist()], pa.int64())

    # Twice the pages are looked at by hash, so that few large or empty ones among them leave enough.
    keyed = pages.withColumn("key", F.xxhash64("html"))
    keys = keyed.select("key").distinct().orderBy("key").limit(2 * size)
    last = keys.agg(F.max("key")).first()[0]
    if last is None:
        return []
    chosen = keyed.where(F.col("key") <= last).dropDuplicates(["key"]).withColumn("blocks", F.arrow_udf(sizes, "bigint")("html"))
    chosen = chosen.where(F.col("blocks").between(1, SAMPLE_BLOCKS)).orderBy("key").limit(size)

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for n in range(batch.num_rows):
                page = leaf_blocks(batch.column("html")[n].as_py())
                content = vectors.content(page)
                paths = pa.array([[list(block.path) for block in page]], pa.list_(pa.list_(pa.string())))
                packed = pa.array([content.tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(n, 1), paths, packed], names=["key", "paths", "content"])

    found = chosen.select("key", "html").mapInArrow(vectors_of, "key bigint, paths array<array<string>>, content binary").toArrow()
    rows = sorted(zip(*(found[c].to_pylist() for c in ("key", "paths", "content"))), key=lambda row: row[0])
    return [
        ([tuple(path) for path in paths], np.frombuffer(content, np.float32).reshape(len(paths), -1)) for _, paths, content in rows
    ]


def extract_text(
    pages: DataFrame,
    columns: list[str],
    html_column: str = "html",
    sample: int = SAMPLE_PAGES,
) -> DataFrame:
    """One row per page: the given columns, ``text``, and the numbers of main and of all blocks."""
    own = pages.select(F.struct(*[quoted(c) for c in columns]).alias("row"), text_of(html_column).alias("html"))
    parameters = train_labeller(sample_pages(own.select("html"), sample))

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors = Vectors()
        for batch in batches:
            texts, main, total = [], [], []
            htmls = batch.to_pylist()
            for begin, end in blocks(htmls, PAGE_BLOCK):
                parsed = [leaf_blocks(html) for html in htmls[begin:end]]
                scores = lstm.label(parameters, [vectors.page(page) for page in parsed])
                for page, score in zip(parsed, scores):
                    kept = [block.text for block, s in zip(page, score) if s > 0]
                    texts.append("\n".join(kept))
                    main.append(len(kept))
                    total.append(len(page))
            yield pa.StructArray.from_arrays(
                [pa.array(texts, pa.string()), pa.array(main, pa.int64()), pa.array(total, pa.int64())],
                names=["text", "main_blocks", "all_blocks"],
            )

    read = F.arrow_udf(scan, "struct<text:string,main_blocks:bigint,all_blocks:bigint>")
    found = own.select("row", read("html").alias("found"))
    return found.select(*[F.col("row")[c].alias(c) for c in columns], "found.text", "found.main_blocks", "found.all_blocks")
