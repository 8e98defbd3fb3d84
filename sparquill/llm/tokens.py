"""Token counts and piece boundaries by a public sub-word tokenizer, once per text, in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A vocabulary of byte-level BPE ranks for many languages, on the driver; the workers get it with the job.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# fixed value: the public pre-tokenisation pattern of this byte-level BPE family
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("sparquill", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_SENT: set[tuple[str, str]] = set()


def _send(spark: SparkSession, vocabulary: str) -> str:
    """Sends the file to the session's workers, once per application; its name there."""
    sent = (spark.sparkContext.applicationId, vocabulary)
    if sent not in _SENT:
        spark.sparkContext.addFile(vocabulary)
        _SENT.add(sent)
    return Path(vocabulary).name


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    return len(_encoding(vocabulary).encode_ordinary(text))


def text_pieces(text: str, capacity: int, vocabulary: str = VOCABULARY) -> list[tuple[int, int, int, int]]:
    """(token_start, token_end, char_start, char_end) of pieces of at most ``capacity`` tokens of the whole text.

    A text within the capacity is one piece, an empty one none. Pieces follow
    each other without gap or overlap and end between characters, so a piece of
    an oversized text may be a few tokens short of full.
    """
    encoding = _encoding(vocabulary)
    ids = encoding.encode_ordinary(text)
    if len(ids) <= capacity:
        return [(0, len(ids), 0, len(text))] if ids else []
    ends = np.cumsum([len(b) for b in encoding.decode_tokens_bytes(ids)])
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    first = (data & 0xC0) != 0x80  # the first byte of a character
    chars = np.append(np.cumsum(first) - first, len(text))  # characters before each byte
    out, start = [], 0
    while start < len(ids):
        end = min(start + capacity, len(ids))
        while end < len(ids) and end > start + 1 and not first[ends[end - 1]]:
            end -= 1
        out.append((start, end, int(chars[ends[start - 1]]) if start else 0, int(chars[ends[end - 1]])))
        start = end
    return out


def _mapped(df: DataFrame, id_col: str, text_col: str, keep: Sequence[str], vocabulary: str, make, kind: pa.DataType, name: str, sql: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__text").schema) + f", {name} {sql}"
    heads = ["id", *keep]
    file = _send(df.sparkSession, vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(file)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text")).to_pylist()
            made = pa.array([make(t or "", path) for t in texts], kind)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(heads))] + [made], names=[*heads, name])

    return rows.mapInArrow(read, schema)


def with_token_counts(df: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """id, the ``keep`` columns and n_tokens, without the text; null and empty texts have 0 tokens."""
    return _mapped(df, id_col, text_col, keep, vocabulary, lambda t, v: count_tokens(t, v) if t else 0, pa.int32(), "n_tokens", "int")


_PIECE = ("token_start", "token_end", "char_start", "char_end")


def with_token_pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, keep: Sequence[str] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """id, the ``keep`` columns and pieces (array of token_start, token_end, char_start, char_end), without the text; see ``text_pieces``."""
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in _PIECE]))
    make = lambda t, v: [dict(zip(_PIECE, p)) for p in text_pieces(t, capacity, v)] if t else []
    return _mapped(df, id_col, text_col, keep, vocabulary, make, kind, "pieces", "array<struct<" + ", ".join(f"{n}: int" for n in _PIECE) + ">>")
