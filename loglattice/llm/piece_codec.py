"""SentencePiece encoding and decoding through a table of distinct marked words.

The model turns spaces into the marker U+2581 and puts one marker before a text. No piece of a
model that this operator accepts has a marker after another character, so no merge crosses the
place before a run of markers, nor, as no piece has a line feed, the place before one: a text is a
sequence of marked words (a run of markers or a line feed, and what follows), and each is segmented
by itself. Every distinct marked word is segmented and decoded
once per table, and ids, counts and surfaces are joined back by position. Tables live in the
Python worker, over batches and tasks, and start afresh at ``TABLE_WORDS`` words, which bounds
memory and changes no result. Rows never move: there is no shuffle.

Defined results: a null text is empty; an empty text gives the end id only and decodes to an empty
text. U+2581 in a text counts as a space, as it does in the library. Rows are independent, so
repeated rows agree; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import whole
from loglattice.llm.tokenizer_files import resolve

MODEL = "piece_bpe_32k.model"
MARK = "▁"
TABLE_WORDS = 200_000
MARKED = re.compile(r" +[^ \n]*|\n[^ \n]*")


class WordTable:
    """Distinct marked words (a run of spaces, or one line feed, and what follows) with their ids."""

    def __init__(self, model: str, limit: int = TABLE_WORDS) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=resolve(model))
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.vocab_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in pieces):
            raise ValueError(f"{model}: a piece crosses a whitespace marker")
        if self.lib.encode("  a") == self.lib.encode(" a") or self.lib.encode("a\nb") == self.lib.encode("a b"):
            raise ValueError(f"{model}: white space is not kept")
        self.ids: dict[str, str] = {}
        self.changed: dict[str, str] = {}  # words that do not decode to themselves
        self.limit = limit

    def learn(self, texts: list[list[str]]) -> None:
        """Segment the marked words that the table does not have, in one call of the library."""
        if len(self.ids) > self.limit:
            self.ids, self.changed = {}, {}
        new = list(set().union(*texts) - self.ids.keys())
        # The library puts the first marker itself and takes it off again; before a line feed it stays a piece of its own.
        found = self.lib.encode([w[1:] if w[0] == " " else w for w in new], num_threads=1)
        lone = [self.lib.piece_to_id(MARK)]
        found = [ids[1:] if w[0] != " " else ids if w != " " else lone for w, ids in zip(new, found, strict=True)]
        surfaces = self.lib.decode([lone + ids if w[0] != " " else ids for w, ids in zip(new, found, strict=True)])
        for word, ids, surface in zip(new, found, surfaces, strict=True):
            self.ids[word] = " ".join(map(str, ids))
            surface = surface if word[0] != " " else " " + surface
            if surface != word:
                self.changed[word] = surface

    def segment(self, marked: list[str]) -> tuple[str, str]:
        """Decimal ids of a text's marked words joined by spaces, and the decoded text."""
        if self.changed and not self.changed.keys().isdisjoint(marked):
            decoded = "".join(self.changed.get(w, w) for w in marked)
        else:
            decoded = "".join(marked)
        return " ".join(map(self.ids.__getitem__, marked)), decoded[1:]


def marked_words(text: str) -> list[str]:
    """The marked words of a text, spaces standing for markers; none for an empty text."""
    return MARKED.findall(" " + text.replace(MARK, " ")) if text else []


_TABLES: dict[str, WordTable] = {}


def word_table(model: str) -> WordTable:
    if model not in _TABLES:
        _TABLES[model] = WordTable(model)
    return _TABLES[model]


def encoder(model: str, with_ids: bool, rows_at_once: int = 64) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Only ``rows_at_once`` texts of an Arrow batch are Python strings at a time."""
    types = dict(n_tokens=pa.int64(), ids_sha256=pa.string(), decoded_sha256=pa.string())
    if with_ids:
        types |= dict(ids=pa.list_(pa.int32()), decoded=pa.string())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(model)
        end = str(table.lib.eos_id())
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                texts = [marked_words(t) for t in part.column("text").to_pylist()]
                table.learn(texts)
                out = []
                for marked in texts:
                    ids, decoded = table.segment(marked)
                    ids = f"{ids} {end}" if ids else end
                    digest = [hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    out.append((ids.count(" ") + 1, *digest, *([np.fromstring(ids, np.int32, sep=" "), decoded] if with_ids else [])))
                cells = [pa.array(list(column), of) for column, of in zip(zip(*out, strict=True), types.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *cells], names=["id", *types])

    return encode


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """Per row: ``id_col``, ``n_tokens`` (end id included), ``ids_sha256``, ``decoded_sha256``; ``ids`` and ``decoded`` on request."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), whole(F.col(text_col)).alias("text"))
    schema = "id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"
    done = rows.mapInArrow(encoder(model, with_ids), schema)
    return done.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
