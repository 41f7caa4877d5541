"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode`` adds the ids of a text as packed little-endian unsigned 32-bit integers, ``decode``
turns packed ids into raw bytes (a cut in mid-character stays a cut: nothing is replaced).

Long texts are split with a regular expression before the library sees them, only at places
that no match of the pre-token pattern crosses: after a letter or digit, before anything else.
(No alternative of the pattern takes a letter or digit and then another kind of character.) Both
sides are characters that all versions of Unicode class alike. So ids equal those of the whole text,
while one call holds a bounded piece; a run that has no such place stays whole.

Defined results: null text counts as empty, has no ids and decodes to no bytes. Rows map one to
one, so ties, repeated rows, empty tables and extra columns are untouched; extra columns with
the name of an output column are replaced by it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm.base import query, table

#: Characters of one call of the library.
PIECE = 1 << 16
#: Letters and digits, and other characters, that every version of Unicode since 3.0 classes alike.
_SAFE = regex.compile(
    r"(?<=[A-Za-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF\u3041-\u3094\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3])"
    r"(?=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\u3001\u3002])"
)


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The library's encoder over the rank file at ``path`` (read once per worker)."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text cut at safe boundaries into pieces of ``size`` characters or little more."""
    begin = 0
    while len(text) - begin > size:
        cut = _SAFE.search(text, begin + size)
        if cut is None or cut.start() >= len(text):
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


def encode_text(text: str, path: str, pattern: str) -> bytes:
    """Ids of one text, packed."""
    ids = encoding(path, pattern).encode_ordinary
    if len(text) <= PIECE:
        return np.array(ids(text), dtype="<u4").tobytes()
    return b"".join(np.array(ids(piece), dtype="<u4").tobytes() for piece in pieces(text))


def decode_ids(packed: bytes, path: str, pattern: str) -> bytes:
    """Raw bytes of packed ids."""
    return encoding(path, pattern).decode_bytes(np.frombuffer(packed, dtype="<u4").tolist())


def encode(path: str, pattern: str, text: Column) -> Column:
    """Column expression: packed ids of a text column."""

    @F.arrow_udf("binary")
    def packed_ids(column: pa.Array) -> pa.Array:
        return pa.array([encode_text(t.as_py() or "", path, pattern) for t in column], type=pa.binary())

    return packed_ids(text)


def decode(path: str, pattern: str, packed: Column) -> Column:
    """Column expression: raw bytes of a column of packed ids."""

    @F.arrow_udf("binary")
    def raw_bytes(column: pa.Array) -> pa.Array:
        return pa.array([decode_ids(p.as_py() or b"", path, pattern) for p in column], type=pa.binary())

    return raw_bytes(packed)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with packed ``ids`` and the ``decoded`` bytes of these ids."""
    with_ids = docs.withColumn("ids", encode(path, pattern, F.col("text")))
    return with_ids.withColumn("decoded", decode(path, pattern, F.col("ids")))


@query("op2_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document, and of the bytes these ids decode to."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
