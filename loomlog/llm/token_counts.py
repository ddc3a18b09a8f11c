"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is cut where the byte-level splitter always cuts: before a single space between two characters that are not
white space. No token and no special string of the vocabulary crosses such a place, so the counts of the parts add
up exactly, and a very long text never meets the encoder as one string. Parts repeat, so a task counts each distinct
part once in a table of bounded size; new parts go to the encoder in batches of about equal bytes.

Defined results: null and empty texts have no tokens; a text without a safe boundary is encoded whole; repeated rows
are counted alike; an empty table gives an empty result; other columns than the two named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.batches import slices
from loomlog.session import ship_by_value

ship_by_value(__name__)

SLICE_BYTES = 4 << 20  # text held as Python strings at a time
BATCH_BYTES = 64 << 10  # of parts that the encoder gets at a time
TABLE_SIZE = 400_000  # distinct parts remembered by a task; beyond it the table starts afresh
SPACE = "\u0120"  # fixed value: how byte-level vocabularies write a space
LONG_PART = 256  # longer parts are counted but not remembered

UNSAFE = re.compile(r"\s \s?|\A | (?=\s)| \Z")  # a space that is no safe boundary
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")


def safe_parts(text: str) -> list[str]:
    """The text cut at its safe boundaries; the space of a boundary is left out (it leads the part that follows)."""
    return BOUNDARY.split(text) if UNSAFE.search(text) else text.split(" ")


class PartCounter:
    """Counts the tokens of texts; one for each task."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leads = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.leads[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(SPACE)]] = True
        self.table: dict[str, int] = {}

    def alone(self, parts: list[str]) -> list[int]:
        """Tokens of each part, encoded one by one in batches balanced by bytes."""
        return [n for batch in self.batches(parts) for n in map(len, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))]

    def spaced(self, parts: list[str]) -> list[int]:
        """Tokens of each part with a space before it.

        The boundaries between the parts are safe, so a whole batch goes in as one text; its tokens with a leading
        space begin the parts.
        """
        out: list[int] = []
        for batch in self.batches(parts):
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(batch)], add_special_tokens=False)[0].ids)
            begins = np.flatnonzero(self.leads[ids])
            out += np.diff(begins, append=len(ids)).tolist()
        return out

    @staticmethod
    def batches(parts: list[str]) -> Iterator[list[str]]:
        start, held = 0, 0
        for i, part in enumerate(parts):
            held += len(part) + 1
            if held >= BATCH_BYTES:
                yield parts[start : i + 1]
                start, held = i + 1, 0
        if start < len(parts):
            yield parts[start:]

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [safe_parts(text) if text else [] for text in texts]
        first = self.alone([parts[0] for parts in cut if parts])  # has no space before it
        seen: set[str] = set()
        for parts in cut:
            seen.update(parts[1:])
        if len(self.table) > TABLE_SIZE:
            self.table = {}
        table = self.table
        new = [part for part in seen if part not in table]
        odd = [part for part in new if " " in part or part[-1:].isspace()]
        fresh = dict(zip(odd, self.alone([" " + part for part in odd])))
        plain = [part for part in new if part not in fresh] if odd else new
        fresh.update(zip(plain, self.spaced(plain), strict=True))
        table.update(fresh)
        heads = iter(first)
        counts = [next(heads) + sum(map(table.__getitem__, parts[1:])) if parts else 0 for parts in cut]
        for part in fresh:
            if len(part) > LONG_PART:
                del table[part]
        return counts


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every document, with the tokenizer file at ``path`` on every machine.

    Scan splits are cut by bytes already, so no exchange is needed to balance the tasks.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        counter = PartCounter(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = part.column("text")
                counts = counter.count(texts.to_pylist())
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
