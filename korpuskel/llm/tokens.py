"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern of the byte-level vocabularies. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 32 << 20


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def with_token_counts(docs: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``docs`` without ``text``, with the number of its tokens in ``out``; 0 for null and empty texts.

    Whole texts are counted. The vocabulary file is read on the driver and
    broadcast (at most ``MAX_VOCABULARY_BYTES``); a Python worker builds the
    tokenizer once. Strings of special tokens are ordinary text.
    """
    data = Path(vocabulary).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    sent = docs.sparkSession.sparkContext.broadcast(data)
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(out, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(sent.value, pattern).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sizes, pa.int64())], names=[*kept, out])

    return docs.select(*kept, F.col(text)).mapInArrow(count, schema)
