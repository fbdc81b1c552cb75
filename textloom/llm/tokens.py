"""Sizes of texts in tokens of a public tokenizer. The driver reads the vocabulary file and sends it to the executors once."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the splitting pattern these vocabularies were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Bytes of a vocabulary file that are sent at most.
MOST_BYTES = 64 << 20


def vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return data


@lru_cache(4)
def _encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, data: bytes | None = None) -> int:
    """Number of tokens of a text; 0 for null and empty texts."""
    return len(_encoding(data or vocabulary()).encode_ordinary(text)) if text else 0


def sized(df: DataFrame, column: str, path: str = VOCABULARY) -> DataFrame:
    """The other columns of df and ``tokens``, the size of the named one; Arrow batches, no shuffle."""
    rest = [c for c in df.columns if c != column]
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in b.column(len(rest)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), n], names=[*rest, "tokens"])

    from pyspark.sql import types as T

    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField("tokens", T.LongType())])
    return df.select(*rest, column).mapInArrow(run, schema)
