"""Token counts with a public tokenizer, in Python workers fed by Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabularies lie; the path is a parameter everywhere.
TOKENIZER = os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")
#: How the byte-level vocabularies cut a text before merging (fixed value, as published with them).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_LOADED: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a worker process, loaded once."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of one text; half of a surrogate pair counts as the replacement character."""
    try:
        return len(encoder(path).encode_ordinary(text))
    except UnicodeEncodeError:
        return len(encoder(path).encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")))


def with_token_counts(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of each text; a null or empty text has 0 tokens.

    Whole texts are counted; repeated ones once a batch.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            counts = [count_tokens(t, path) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, schema)
