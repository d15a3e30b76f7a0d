"""Token counts with a public tokenizer, loaded once in every Python worker."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY = 50_257

# Fixed value: the published split pattern of this byte-level vocabulary.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER):
    """The tiktoken encoding read from the ranks file at ``path``."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str = TOKENIZER) -> list[int]:
    """Token ids of a text; lone surrogates count as replacement characters."""
    try:
        return encoder(path).encode_ordinary(text)
    except UnicodeEncodeError:
        return encoder(path).encode_ordinary(text.encode("utf-8", "replace").decode())


def encode_array(text: str, path: str = TOKENIZER):
    """The same as an array, without a Python number per token."""
    try:
        return encoder(path).encode_to_numpy(text, disallowed_special=())
    except UnicodeEncodeError:
        return np.array(encode(text, path), np.uint32)


def with_token_count(df: DataFrame, text_col: str, out: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """``df`` with a column of token counts; a null text counts 0 tokens."""

    def run(batches):
        for batch in batches:
            counts = [0 if t is None else len(encode_array(t, path)) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, out])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])
    return df.mapInArrow(run, schema)
