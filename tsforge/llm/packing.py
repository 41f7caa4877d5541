"""Cost-balanced packing of token sequences.

A document is its ids and one end id. It is cut into whole sequences of ``capacity`` ids, then
one piece of the largest multiple of ``unit`` ids that is left, then the rest, so pieces fit
together with little padding at no more than two cuts besides the full sequences. A piece of n
ids costs ``n + quadratic * n * n``: the linear part of a layer and attention inside the piece.
Pieces are assigned in descending order, each to the sequence of the lowest cost so far that
has room for it (of equal costs the one with the least room, then the first); a new sequence is
opened where none has.

Pieces are dealt to shards of about ``shard_rows`` by a hash of their row number in a written
table, and each shard is packed by itself. Only lengths and checksums travel, never ids.

Defined results: null text counts as empty and is the end id alone. Repeated rows are packed
once for each row, ties in length are broken by document, start and row number, and an empty
table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm.base import materialise, query, table

CAPACITY, UNIT, END, QUADRATIC, SHARD_ROWS = 1024, 128, 0, 1 / 512, 20_000
#: Bytes of pre-tokens and ids that a worker keeps between batches, and what an entry takes beside them.
CACHE, ENTRY = 48 << 20, 200


class Ids:
    """Packed ids of texts under a byte-level BPE file of the tokenizers library.

    A space after a character that is no space begins a new pre-token, so a text without double
    spaces is encoded unit by unit, and units repeat. Units go through tiktoken with the ranks of
    the same file. The tokenizers library itself takes texts with two spaces in a row, special
    strings, or characters that Unicode versions class differently.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.special = tuple(t["content"] for t in content.get("added_tokens", []))
        to_byte = _byte_of()
        ranks = {
            bytes(to_byte[c] for c in token): i
            for token, i in content["model"]["vocab"].items()
            if token not in self.special
        }
        self.unit = tiktoken.Encoding(
            "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.odd = False

    def __getitem__(self, unit: str) -> bytes:
        got = self.known.get(unit)
        if got is None:
            if not unit.isascii() and any(unicodedata.category(c) == "Cn" for c in unit):
                self.odd = True
                return b""
            got = np.array(self.unit(" " + unit), dtype="<u4").tobytes()
            size = 4 * len(unit) + len(got) + ENTRY
            if self.held + size > CACHE:
                self.known.clear()
                self.held = 0
            if size <= CACHE // 64:
                self.known[unit] = got
                self.held += size
        return got

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        if not first.isascii() and any(unicodedata.category(c) == "Cn" for c in first):
            return self.whole(text)
        self.odd = False
        head = np.array(self.unit(first), dtype="<u4").tobytes()
        out = head + b"".join(map(self.__getitem__, rest))
        return self.whole(text) if self.odd else out


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Ids:
    return Ids(path)


def cuts(n: int, capacity: int = CAPACITY, unit: int = UNIT) -> list[int]:
    """Piece boundaries of ``n`` ids, from 0 to ``n``."""
    full = n - n % capacity
    out = list(range(0, full + 1, capacity))
    even = full + (n - full) // unit * unit
    for at in (even, n):
        if at > out[-1]:
            out.append(at)
    return out


def pieces(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens), one row per piece."""
    piece = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    kind = pa.struct([("doc_tokens", pa.int64()), ("pieces", pa.list_(piece))])

    @F.arrow_udf("doc_tokens long, pieces array<struct<start: long, length: long, ids_crc32: long>>")
    def cut(column: pa.Array) -> pa.Array:
        ids = tokenizer(path)
        tail = np.array([end], dtype="<u4").tobytes()
        tokens, start, length, crc, offsets = [], [], [], [], [0]
        for text in column:
            packed = ids.encode(text.as_py() or "") + tail
            tokens.append(len(packed) // 4)
            edges = cuts(tokens[-1])
            for a, b in zip(edges, edges[1:]):
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(packed[4 * a : 4 * b]))
            offsets.append(len(start))
        flat = pa.StructArray.from_arrays([pa.array(x, type=pa.int64()) for x in (start, length, crc)], fields=list(piece))
        lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), flat)
        return pa.StructArray.from_arrays([pa.array(tokens, type=pa.int64()), lists], fields=list(kind))

    cut_docs = docs.select("doc_id", cut("text").alias("cut"))
    return cut_docs.select("doc_id", F.col("cut.doc_tokens").alias("doc_tokens"), F.inline("cut.pieces")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens"
    )


def balance(lengths: list[int], capacity: int = CAPACITY, quadratic: float = QUADRATIC) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each length, which come in descending order."""
    room = [capacity] * -(-sum(lengths) // capacity)
    # A heap of (cost, sequence) for each free room, and the lowest cost in each.
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    heaps[-1] = [(0.0, k) for k in range(len(room))]
    lowest = np.full(capacity + 1, np.inf)
    lowest[-1] = 0.0 if room else np.inf
    where, offset = [], []
    for n in lengths:
        free = n + int(lowest[n:].argmin())
        if heaps[free]:
            cost, k = heapq.heappop(heaps[free])
            lowest[free] = heaps[free][0][0] if heaps[free] else np.inf
        else:
            cost, k, free = 0.0, len(room), capacity
            room.append(capacity)
        where.append(k)
        offset.append(capacity - free)
        room[k] = free - n
        heapq.heappush(heaps[room[k]], (cost + n + quadratic * n * n, k))
        lowest[room[k]] = heaps[room[k]][0][0]
    return where, offset


def pack(cut: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``cut`` (from ``pieces``) with the sequence and the offset of each piece."""
    numbered = materialise(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-numbered.count() // shard_rows))
    dealt = numbered.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("_row", "ascending")])
        where, offset = balance(rows["length"].to_pylist(), capacity)
        base = rows["_shard"][0].as_py() << 32
        ids = pa.array(np.array(where, dtype=np.int64) + base)
        rows = rows.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return rows.append_column("sequence_id", ids).append_column("offset", pa.array(offset, type=pa.int64()))

    return dealt.groupBy("_shard").applyInArrow(fill, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Sequences of ``capacity`` tokens holding every id of ``docs`` once."""
    return pack(pieces(docs.select(F.col("doc_id").cast("long"), "text"), path), capacity)


@query("op8_cost_packing")
def cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
