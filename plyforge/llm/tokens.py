"""Sizes of texts in tokens of a public byte-level BPE tokenizer; the vocabulary file is a parameter and is read on the executors."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    """The tokenizer, one per worker process; special strings in a text are ordinary text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return run


def token_counts(df: DataFrame, keep: dict[str, str], column: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` (new name -> column) and ``n_tokens`` of the whole text; 0 for null."""
    rows = df.select(*(F.col(f"`{c}`").alias(n) for n, c in keep.items()), F.col(f"`{column}`").alias("_text"))
    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in keep)
    return rows.mapInArrow(_count(path), f"{kinds}, n_tokens long")
