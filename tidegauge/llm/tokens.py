"""Sizes of texts in tokens, counted over Arrow buffers without a Python object per text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Bytes handled at once, so that the work arrays stay small whatever the texts' lengths.
CHUNK_BYTES = 4 << 20


def _classes() -> np.ndarray:
    """0: separator (blank, tab, CR, LF), 1: word character, 2: anything else; all bytes of non-ASCII characters are 2."""
    table = np.full(256, 2, np.uint8)
    table[list(b" \t\r\n")] = 0
    table[[b for b in range(128) if chr(b).isalnum() or b == ord("_")]] = 1
    return table


CLASSES = _classes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; null texts are empty."""
    if pa.types.is_large_string(texts.type):
        texts, width = texts.fill_null(""), np.int64
    else:
        texts, width = texts.cast(pa.string()).fill_null(""), np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def chunks(data: np.ndarray, ends: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges ``(first, last)`` of texts of about ``size`` bytes; one long text makes a chunk of its own."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = int(np.searchsorted(ends, ends[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def count_tokens(texts: pa.Array) -> np.ndarray:
    """Tokens per text: maximal runs of word characters and maximal runs of other non-blank characters."""
    data, ends = buffers(texts)
    out = np.zeros(len(texts), np.int64)
    for i, j in chunks(data, ends):
        lo, hi = ends[i], ends[j]
        if hi == lo:
            continue
        cls = CLASSES[data[lo:hi]]
        begins = cls != 0
        begins[1:] &= cls[1:] != cls[:-1]
        firsts = ends[i:j][ends[i + 1 : j + 1] > ends[i:j]] - lo
        begins[firsts] = cls[firsts] != 0
        out[i:j] = np.diff(np.searchsorted(np.flatnonzero(begins), ends[i : j + 1] - lo))
    return out


@F.arrow_udf(LongType())
def _token_count(texts: pa.Array) -> pa.Array:
    return pa.array(count_tokens(texts), pa.int64())


def token_count(text: Column) -> Column:
    """Number of tokens of a text column; 0 for null and empty texts."""
    return _token_count(text)


#: Fixed value: how the byte-level vocabularies cut a text before merging.
BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_token_count(text: Column, ranks_path: str) -> Column:
    """Tokens of a text under a public byte-level vocabulary in tiktoken's rank format; 0 for null and empty texts.

    ``ranks_path`` must be readable on every executor; each Python worker loads it once. Long texts are encoded whole.
    """

    @F.arrow_udf(LongType())
    def count(texts: pa.Array) -> pa.Array:
        encode = _encoding(ranks_path).encode_ordinary
        return pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return count(text)


def document_sizes(documents: DataFrame, text: str = "text", ranks_path: str | None = None) -> DataFrame:
    """``(doc_id, tokens)``, one row per document id; repeated rows count once, null ids are left out.

    With ``ranks_path`` the tokens are those of that vocabulary.
    """
    count = bpe_token_count(F.col(text), ranks_path) if ranks_path else token_count(F.col(text))
    sized = documents.select("doc_id", count.alias("tokens")).filter(F.col("doc_id").isNotNull())
    return sized.groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
