"""Token ids of every text by a public byte-level vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .bpe import DEFAULT_DIR
from .batches import small_batches

#: Encoders of this Python worker, by path.
_ENCODERS: dict = {}


def encoder(path: str):
    from .bpe import Encoder

    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = f"{DEFAULT_DIR}/byte_bpe_50k.json") -> DataFrame:
    """(id, ids) for every row. Null and empty texts give an empty list; repeated rows and null ids stay as they are.

    vocabulary is the path of a byte-level BPE file with merges, readable on every executor. Each text is encoded whole,
    in a time linear in its length, without special tokens. Nothing is shuffled.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode = encoder(vocabulary).encode
        for batch in batches:
            offsets, flat = [0], []
            for text in batch.column(1).to_pylist():
                flat += encode(text)
                offsets.append(len(flat))
            values = pa.array(np.array(flat, dtype=np.int32))
            ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_column, "ids"])

    return small_batches(docs.select(id_column, text_column)).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")
