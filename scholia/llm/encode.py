"""Token ids and token counts of a whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.bpe import TOKENIZER_DIR, encoder

#: Texts worked on at once; bounds a worker's memory to a few MB beside its cache.
_SLICE = 500


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(id, ids): the token ids of each row's text, without special tokens.

    A null or an empty text has the empty list; a null id is kept. Repeated rows give repeated
    rows, an empty table an empty result; other columns are never read. Strings that look like
    special tokens are ordinary text. No shuffle.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(directory).packed
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                each = list(map(packed, part.column(1).to_pylist()))
                offsets = np.cumsum([0, *map(len, each)], dtype=np.int64) // 4
                flat = pa.py_buffer(b"".join(each))
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, flat]))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["id", "ids"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(id, n_tokens) of each row's text; 0 for a null or empty one. Same rules as ``encode_corpus``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_one = encoder(directory).count
        for batch in batches:
            n = list(map(count_one, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, f"id {id_type}, n_tokens bigint").withColumnRenamed("id", id_col)
