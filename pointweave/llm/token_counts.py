"""Token counts of whole texts, without keeping ids.

Cases: a null text counts as empty (0 bytes, 0 tokens); rows with a null or a
repeated id give a row each; columns other than the two named are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import balanced, cut_long, encoder, text_slices

#: A text of more characters goes to a ``.model`` tokenizer in parts.
PART_CHARS = 1 << 16


class PieceCounter:
    """Counts of a sentencepiece model; long texts go in parts, where the model can hold no piece over a space.

    A part begins at the space before a word, which the model's own leading mark
    stands for, so the parts' counts add up to the whole text's.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i).lstrip("▁") for i in range(self.model.get_piece_size()))
        marked = self.model.encode("a b", out_type=str)
        self.splits = not any("▁" in p for p in pieces) and marked == self.model.encode("a", out_type=str) + self.model.encode("b", out_type=str)

    def count_batch(self, texts: list[str | None]) -> np.ndarray:
        full = [x or "" for x in texts]
        parts = [[x] if len(x) <= PART_CHARS or not self.splits else [part.removeprefix(" ") for part in cut_long(x, PART_CHARS)] for x in full]
        lengths = [len(ids) for batch in balanced(x for own in parts for x in own) for ids in self.model.encode(batch, num_threads=1)]
        ends = np.cumsum([0, *lengths])[np.cumsum([0, *map(len, parts)])]
        return np.diff(ends)


@lru_cache(maxsize=4)
def counter(path: str):
    """What counts tokens by the file's library, kept for the worker's later batches and tasks."""
    return PieceCounter(path) if path.endswith(".model") else encoder(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit of every row.

    Texts are cut at boundaries that no token crosses, so no call holds a long
    text whole unless it has no such boundary; new segments go to the library in
    calls balanced by bytes, and each distinct one is encoded once a worker.
    """
    schema = f"key {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, texts in text_slices(b.column(1)):
                counts = pa.array(counter(tokenizer_path).count_batch(texts), pa.int64())
                part = b.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), counts], ["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, schema).select(F.col("key").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
