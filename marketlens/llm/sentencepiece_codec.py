"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the model holds a whitespace marker behind another character, so no merge crosses the place before a run
of markers. A text, with the marker that the library puts before it, thus falls into chunks (a run of markers and what
follows up to the next run) that can be segmented alone. Each task keeps a table from distinct chunk to ids: a chunk is
segmented once, and a text's ids are joined back by position from the table. The table is emptied at ``table_size``
chunks, so that a task's memory is bounded; chunks of any length are segmented whole.

Empty and null texts have no ids and decode to the empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marketlens.llm.common import short_batches

#: The whitespace marker.
MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model


def chunk_safe(path: str) -> bool:
    """Whether no piece of the model crosses the place before a whitespace marker."""
    m = _model(path)
    return not any(re.search(f"[^{MARK}]{MARK}", m.id_to_piece(i)) for i in range(m.get_piece_size()))


class ChunkTable:
    """Distinct chunk to ids (as int32 bytes)."""

    def __init__(self, path: str, size: int):
        self.model, self.size, self.ids = _model(path), size, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [_CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self.ids) > self.size:
            self.ids.clear()
        new = list({c for p in parts for c in p if c not in self.ids})
        # the library puts the first marker itself
        for c, ids in zip(new, self.model.encode([c[1:] for c in new], num_threads=1) if new else [], strict=True):
            self.ids[c] = np.asarray(ids, np.int32).tobytes() if c != " " else self._alone()
        get = self.ids.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def _alone(self) -> bytes:
        """A marker with nothing behind it, at the end of a text: the library can't be asked for it, as it has no ids for an empty text."""
        return np.asarray([self.model.piece_to_id(MARK)], np.int32).tobytes()


def _with(df: DataFrame, col: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != col] + [T.StructField(col, kind)])


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", table_size: int = 300_000) -> DataFrame:
    """``df`` with column ``ids`` (array<int>): what the library's encode() gives for ``text``. Other columns stay."""
    if not chunk_safe(model_path):
        raise ValueError("a piece of this model crosses whitespace markers; the chunk table would not be exact")
    schema, names = _with(df, ids, T.ArrayType(T.IntegerType())), [c for c in df.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_table = ChunkTable(model_path, table_size)
        for b in batches:
            got = chunk_table.encode([x or "" for x in b.column(b.schema.get_field_index(text)).to_pylist()])
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(got), np.int32))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.ListArray.from_arrays(pa.array(ends), values)], names=[*names, ids])

    return short_batches(df).mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with column ``text``: what the library's decode() gives for ``ids``; null ids are no ids."""
    schema, names = _with(df, text, T.StringType()), [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for b in batches:
            got = [model.decode(x) if x else "" for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(got, pa.string())], names=[*names, text])

    return short_batches(df).mapInArrow(run, schema)
