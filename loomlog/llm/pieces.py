"""SentencePiece encoding and decoding with a table of distinct marked words.

The model writes a space as the marker U+2581 and puts one before the text. Where no piece has a marker behind another
character, no piece crosses from a word into the marker of the next, so the marked words (a run of markers and what
follows up to the next marker) are segmented one by one. A task segments each distinct marked word once, keeps it in
a table of bounded size and joins the ids back by position. A corpus-wide table would have to shuffle every word of
every text to meet its ids again; the table of a task needs no exchange.

:func:`round_trip` does both in one function, so a task slot keeps one worker and one model. Models with a piece that crosses
a marker are refused with an error.

Defined results: null and empty texts have no ids and decode to the empty text; null id lists decode to the empty
text; repeated rows give equal results; an empty table gives an empty result; columns not named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.batches import hand_back, slices
from loomlog.session import ship_by_value

ship_by_value(__name__)

MARK = "\u2581"  # fixed value of the library
MARKED = re.compile("\u2581+[^\u2581]*")
IRREGULAR = re.compile("  |\\A | \\Z|\u2581")  # more than single spaces between words
SLICE_BYTES = 1 << 20  # text held as Python strings at a time
BATCH_CHARS = 16 << 10  # of new words that the model gets at a time
TABLE_SIZE = 100_000  # words remembered by a task; beyond it the table starts afresh
LONG_WORD = 256


def processor(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size())):
        raise ValueError("pieces of this model cross white space markers; words can't be segmented alone")
    if not model.id_to_piece(model.encode("a")[0]).startswith(MARK):
        raise ValueError("this model puts no marker before a text")
    return model


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker."""
    if not IRREGULAR.search(text):
        return text.split(" ")
    return [word[1:] for word in MARKED.findall(MARK + text.replace(" ", MARK))]


class WordTable:
    """Ids of distinct marked words, as bytes of 32-bit integers; one for each task."""

    def __init__(self, path: str):
        self.model = processor(path)
        self.leads = np.array([self.model.id_to_piece(i).startswith(MARK) for i in range(self.model.get_piece_size())])
        self.lone = np.array([self.model.piece_to_id(MARK)], np.int32).tobytes()
        self.table: dict[str, bytes] = {}

    def segment(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words without inner markers go to the model as one text; the pieces with a marker begin the words."""
        start, held = 0, 0
        for i, word in enumerate(words):
            held += len(word) + 1
            if held >= BATCH_CHARS or i == len(words) - 1:
                batch = words[start : i + 1]
                ids = np.array(self.model.encode(" ".join(batch)), np.int32)
                begins = np.flatnonzero(self.leads[ids])
                data, ends = ids.tobytes(), np.append(begins[1:], len(ids))
                found = [data[a:b] for a, b in zip((begins * 4).tolist(), (ends * 4).tolist())]
                yield from zip(batch, found, strict=True)
                start, held = i + 1, 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        words = [marked_words(text) if text else [] for text in texts]
        seen: set[str] = set()
        for row in words:
            seen.update(row)
        if len(self.table) > TABLE_SIZE:
            self.table = {}
        table = self.table
        new = [word for word in seen if word not in table]
        odd = [word for word in new if not word or MARK in word or " " in word]
        for word, ids in zip(odd, self.model.encode(odd)):
            table[word] = np.array(ids, np.int32).tobytes() if word else self.lone  # a lone marker, as before a trailing space
        table.update(self.segment([word for word in new if word not in table] if odd else new))
        out = [b"".join(map(table.__getitem__, row)) for row in words]
        for word in new:
            if len(word) > LONG_WORD:
                del table[word]
        return out


def id_lists(found: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every document, without begin or end ids."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), id_lists(table.encode(part.column("text").to_pylist()))], ["doc_id", "ids"])
        del table
        hand_back()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(coded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, ids, text) for every list of ids."""
    rows = coded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = processor(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = [model.decode(row.values.to_numpy().tolist()) if row.is_valid and len(row) else "" for row in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
        del model
        hand_back()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, text): the ids of every document and the text that they decode to."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = table.encode(part.column("text").to_pylist())
                texts = [table.model.decode(np.frombuffer(ids, np.int32).tolist()) if ids else "" for ids in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), id_lists(found), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
        del table
        hand_back()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
