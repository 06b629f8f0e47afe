"""SentencePiece encoding and decoding through tables of distinct marked words.

The library turns every space of a text into a marker and puts one before it. When no piece
has a marker after another character, no merge crosses the begin of a run of markers, so
the text falls apart into marked words (markers, then other characters) that segment
independently. Each block of texts makes a table of its distinct marked words; a word is
segmented the first time a task meets it, and its ids are put back at every position where
it stands. A model whose pieces cross markers, or that rewrites texts, is given whole texts.

The tables belong to tasks, not to the corpus: rare marked words are most of a corpus-wide
table and stand in nearly every text, so bringing their ids back to the texts would shuffle
all texts, while a task segments them in place for less. Blocks bound the memory.

A null text equals an empty one, which has no pieces; with ``end`` it has the end id alone.
Ids that the model does not have are refused by the library. Repeated rows are all returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import quoted
from .common import blocks, text_of

MARKER = "▁"
MARKED_WORD = re.compile(f"{MARKER}+[^{MARKER}]*")
#: Marked words that a task remembers between blocks; the table is begun anew beyond that.
TABLE_WORDS = 300_000
#: Bytes of text encoded at a time, and chunks handed to the library at a time.
TEXT_BLOCK, CALL_CHUNKS = 2_000_000, 10_000

_CROSSING = re.compile(f"[^{MARKER}]{MARKER}")


def _processor(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def splits_at_markers(processor) -> bool:
    """Whether marked words segment independently under this model.

    No piece may cross into a marker; texts must be taken as they are but for one marker
    put before them. Both are read off the model itself.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(processor.serialized_model_proto())
    rules = model.normalizer_spec
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces
    plain = plain and not rules.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
    user_defined = any(piece.type == 4 for piece in model.pieces)
    return plain and not user_defined and not any(_CROSSING.search(piece.piece) for piece in model.pieces)


class ChunkEncoder:
    """Encodes texts with one table of distinct chunks."""

    def __init__(self, model_path: str, end: bool) -> None:
        self.processor = _processor(model_path)
        self.end = [self.processor.eos_id()] if end else []
        self.split = splits_at_markers(self.processor)
        self.forget()

    def forget(self) -> None:
        """Begin the table anew, with the end ids as its row 0."""
        self.table: dict[str, int] = {}
        self.ids = np.array(self.end, np.int32)
        self.sizes = np.array([len(self.end)], np.int64)

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return MARKED_WORD.findall(MARKER + text.replace(" ", MARKER)) if self.split else [text]

    def segment(self, chunks: list[str]) -> None:
        """Add the ids of chunks that the table lacks. The library puts the first marker back."""
        alone = [self.processor.piece_to_id(MARKER)]
        all_ids, all_sizes = [self.ids], [self.sizes]
        for at in range(0, len(chunks), CALL_CHUNKS):
            part = chunks[at : at + CALL_CHUNKS]
            plain = [chunk[1:] for chunk in part] if self.split else part
            found = self.processor.encode(plain, num_threads=1, add_bos=False, add_eos=False)
            if self.split:
                found = [alone if chunk == MARKER else ids for chunk, ids in zip(part, found)]
            all_sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            all_ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(all_sizes[-1].sum())))
        self.table.update(zip(chunks, range(len(self.sizes), len(self.sizes) + len(chunks))))
        self.ids, self.sizes = np.concatenate(all_ids), np.concatenate(all_sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        parts = [self.chunks(text) for text in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = pa.array(list(chain.from_iterable(parts)), pa.large_string()).dictionary_encode()
        return self.encode_chunks(flat.dictionary.to_pylist(), flat.indices.to_numpy(), counts)

    def encode_chunks(self, distinct: list[str], codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for texts given as numbers of distinct chunks and their counts of chunks."""
        if len(self.table) > TABLE_WORDS:
            self.forget()
        if missing := [chunk for chunk in distinct if chunk not in self.table]:
            self.segment(missing)
        rows = np.fromiter(map(self.table.__getitem__, distinct), np.int64, len(distinct))
        # Position join: every chunk's run of ids, the end row after each text's last chunk.
        order = np.insert(rows[codes], np.cumsum(counts), 0)
        begins = np.cumsum(self.sizes) - self.sizes
        lengths = self.sizes[order]
        before = np.cumsum(lengths) - lengths
        spots = np.arange(int(lengths.sum())) + np.repeat(begins[order] - before, lengths)
        owner = np.repeat(np.arange(len(counts)), counts + 1)
        return self.ids[spots], np.bincount(owner, lengths, len(counts)).astype(np.int64)


def decoder(model_path: str):
    """Arrow function: list of ids to the library's text."""

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = _processor(model_path).decode
        for lists in batches:
            texts = []
            for begin in range(0, len(lists), 200):
                texts += decode([row or [] for row in lists.slice(begin, 200).to_pylist()])
            yield pa.array(texts, pa.string())

    return F.arrow_udf(column, "string")


def encode_texts(docs: DataFrame, id_column: str, text_column: str, model_path: str, end: bool = True) -> DataFrame:
    """One row per input row: its id, ``ids`` and the library's ``decoded`` text of those ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(model_path, end)  # one table per task
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin, stop in blocks(texts, TEXT_BLOCK):
                ids, counts = encoder.encode(texts[begin:stop])
                ends = np.cumsum(counts)
                decoded = []
                for low, high in zip((ends - counts).tolist(), ends.tolist()):
                    decoded.append(encoder.processor.decode(ids[low:high].tolist()))
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(begin, stop - begin), pa.ListArray.from_arrays(offsets, pa.array(ids)),
                     pa.array(decoded, pa.string())],
                    names=["id", "ids", "decoded"],
                )

    rows = docs.select(quoted(id_column).alias("id"), text_of(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(encode, f"id {kind}, ids array<int>, decoded string")
    return found.select(F.col("id").alias(id_column), "ids", "decoded")


def decode_ids(rows: DataFrame, ids_column: str, model_path: str, into: str = "decoded") -> DataFrame:
    """The rows with the library's text of a column of id lists; a null list has the empty text."""
    return rows.withColumn(into, decoder(model_path)(quoted(ids_column)))
