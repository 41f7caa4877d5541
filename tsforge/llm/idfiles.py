"""Token ids as binary files, one zstandard frame per document under a shared dictionary.

``write`` lays out a folder:

* ``dictionary``: a zstandard dictionary trained on serialized id arrays of a sample of documents;
* ``shard-NNNNNN-<unique>.ids``: a header (magic, bytes per id, SHA-256 of the dictionary), then one
  frame per document: its ids, little-endian and of fixed width, compressed by themselves;
* ``index``: Parquet with one row per document: its shard and file, where its frame lies, how many
  ids it has and how many ids its shard holds before it.

Documents are in ascending order (null first; rows that share an id by the row number of a written
table) over the shards and inside each. A short document is read by its byte range alone; a
shard whose header names another dictionary is refused.

Shards are written by tasks. A task writes a new file on each attempt and names it in its index rows,
which Spark commits only for the attempt that counts, so files of lost attempts are never read. Files
are reached through Arrow's file systems by the folder's address, which all executors share.

Documents are encoded and compressed where they are read, so only frames travel to the shards.

The dictionary is fitted on a bounded sample: the first ``SAMPLE_CHARS`` characters of the ``SAMPLE`` documents
with the lowest hashes of id and row number. It decides sizes only; every document is written whole. Where
the sample is too small to train on, frames are written without a dictionary.

Defined results: null text counts as empty and is the end id alone. Repeated rows are documents of their
own. An empty table gives an index without rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsforge.llm import terms as tm
from tsforge.llm import text as tx
from tsforge.llm.base import materialise, query, scratch_path, table

END, LEVEL = 1, 3
#: Documents and characters of each that the dictionary is trained on, and its size.
SAMPLE, SAMPLE_CHARS, DICTIONARY = 2048, 1 << 13, 1 << 16
#: Compressed bytes of a shard, bytes of one read, bytes of text worked on at once, and bytes of parts
#: and ids that a worker remembers.
SHARD, READ, SLICE, REMEMBERED = 1 << 25, 1 << 23, 3 << 20, 128 << 20
MAGIC = b"TOKIDS01"
HEADER = len(MAGIC) + 1 + 32
#: White space that the tokenizers split at and drop, whatever stands around it.
_BLANK = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0D])
_INDEX_DDL = "shard int, file string, doc_id long, at long, size long, n_tokens long, before long"


#: Latin letters (ASCII, and the second byte of those in U+00C0 to U+00FF), digits, and marks that are no part of a
#: contraction, a special string or a composed character.
_ASCII = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_LATIN = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_MARK = np.isin(np.arange(256), [ord(c) for c in ',.;:!?()"'])


def parts(raw: np.ndarray, offsets: np.ndarray) -> tuple[tx.Words, np.ndarray]:
    """Parts whose ids do not depend on what stands around them, and which are Latin letters only.

    White space is dropped. A digit is a token of its own. Between a letter and a mark one token ends
    and another begins, in this order or the other.
    """
    n = len(raw)
    inside = ~_BLANK[raw]
    second = np.zeros(n, dtype=bool)
    second[1:] = (raw[:-1] == 0xC3) & _LATIN[raw[1:]]
    first = np.zeros(n, dtype=bool)
    first[:-1] = second[1:]
    ascii_letter, digit, mark = _ASCII[raw], _DIGIT[raw], _MARK[raw]
    edge = np.zeros(n, dtype=bool)
    edge[1:] = (
        digit[1:] | digit[:-1]
        | ((ascii_letter | second)[:-1] & mark[1:])
        | (mark[:-1] & (ascii_letter | first)[1:])
        | (inside[1:] & ~inside[:-1])
    )
    edge[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(edge & inside)
    stop = np.zeros(n + 1, dtype=bool)
    stop[:-1] = edge | ~inside
    stop[n] = True
    stop = np.flatnonzero(stop)
    end = stop[np.searchsorted(stop, start, side="right")]
    bound = np.searchsorted(start, offsets)
    count = np.diff(bound)
    other = np.zeros(n + 1, dtype=np.int32 if n < 1 << 31 else np.int64)
    np.cumsum(~(ascii_letter | first | second), out=other[1:])
    return tx.Words(start, end, np.repeat(np.arange(len(count)), count), count), other[end] == other[start]


class WordIds:
    """Ids of texts under a tokenizer that drops white space and takes runs of letters, single digits
    and runs of other characters as words: a text's ids are those of its ``parts`` in turn. Parts repeat,
    so their ids are remembered, up to a number of bytes. Runs of letters are sent to the library many
    at a time, since the last token of each word is marked as such."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        top = max(vocabulary.values()) + 1
        self.width = 2 if top <= 1 << 16 else 4
        with open(path, encoding="utf-8") as file:
            suffix = json.load(file)["model"]["end_of_word_suffix"]
        self.last = np.zeros(top, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.flat, self.start, self.size = (np.zeros(0, dtype=t) for t in (np.uint32, np.int64, np.int64))

    def _learn(self, words: list[str], found: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        size = np.concatenate(sizes)
        places = range(len(self.start), len(self.start) + len(words))
        self.known.update(zip(words, places))
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.flat = np.concatenate([self.flat, *found])
        self.bytes += sum(map(len, words)) + 170 * len(words) + 4 * int(size.sum())
        return np.arange(places.start, places.stop)

    def slots(self, words: list[str], letters: np.ndarray) -> np.ndarray:
        """Where the ids of each of these distinct words are remembered."""
        if self.bytes > REMEMBERED:
            self.forget()
        # One look at each word: most are known, and the places of the others follow from the order they are learnt in.
        out = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(out < 0)
        order, found, sizes = np.r_[new[letters[new]], new[~letters[new]]], [], []
        names = [words[k] for k in order.tolist()]
        runs = int(letters[new].sum())
        for lo in range(0, runs, 4096):
            hi = min(lo + 4096, runs)
            group = [" ".join(names[k : min(k + 128, hi)]) for k in range(lo, hi, 128)]
            got = self.library.encode_batch_fast(group, add_special_tokens=False)
            ids = np.concatenate([np.array(g.ids, dtype=np.uint32) for g in got])
            found.append(ids)
            sizes.append(np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0))
        for lo in range(runs, len(names), 4096):
            got = [g.ids for g in self.library.encode_batch_fast(names[lo : lo + 4096], add_special_tokens=False)]
            found.append(np.fromiter(chain.from_iterable(got), dtype=np.uint32))
            sizes.append(np.fromiter(map(len, got), dtype=np.int64, count=len(got)))
        if names:
            out[order] = self._learn(names, found, sizes)
        return out

    def encode(self, column: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets) for runs of rows; each row's ids end with ``end``."""
        for first, raw, offsets in tx.slices(column, SLICE):
            w, pure = parts(raw, offsets)
            coded = tm.packed_words(raw, w).dictionary_encode()
            which = coded.indices.to_numpy().astype(np.int64)
            letters = np.zeros(len(coded.dictionary), dtype=bool)
            letters[which] = pure
            slot = self.slots(coded.dictionary.to_pylist(), letters)[which]
            # The end id of a text is one more part, behind the text's own.
            behind = np.cumsum(w.count)
            size = np.insert(self.size[slot], behind, 1)
            start = np.insert(self.start[slot], behind, len(self.flat))
            flat = np.append(self.flat, np.uint32(end))
            total = np.zeros(len(size) + 1, dtype=np.int64)
            np.cumsum(size, out=total[1:])
            # Half the bytes for places, where they are small enough.
            kind = np.int32 if max(len(flat), int(total[-1])) < 1 << 31 else np.int64
            ids = flat[np.repeat((start - total[:-1]).astype(kind), size) + np.arange(total[-1], dtype=kind)]
            yield first, ids, np.r_[0, total[behind + np.arange(1, len(behind) + 1)]]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordIds:
    return WordIds(path)


def train(docs: DataFrame, path: str, end: int = END, sample: int = SAMPLE, size: int = DICTIONARY) -> bytes:
    """A dictionary for the serialized ids of ``docs``, or no bytes where the sample does not yield one."""
    import zstandard

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for _, ids, offsets in tok.encode(batch.column(0), end):
                packed = ids.astype(f"<u{tok.width}")
                found = [packed[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.binary())], names=["ids"])

    numbered = docs.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).withColumn(
        "row", F.monotonically_increasing_id()
    )
    lowest = numbered.orderBy(F.xxhash64("doc_id", "row"), "row").limit(sample).select("text")
    try:
        found = lowest.mapInArrow(serialize, "ids binary").toArrow()["ids"].to_pylist()
        return zstandard.train_dictionary(size, found).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def encode(docs: DataFrame, path: str, dictionary: bytes, end: int = END, level: int = LEVEL) -> DataFrame:
    """(doc_id, frame, n_tokens, width, row), written: each document's ids as a frame."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tok = tokenizer(path)
        packer = zstandard.ZstdCompressor(level=level, write_checksum=True, **_codec(dictionary))
        for batch in batches:
            for first, ids, offsets in tok.encode(batch.column(1), end):
                packed = memoryview(ids.astype(f"<u{tok.width}")).cast("B")
                edges = (offsets * tok.width).tolist()
                frames = [packer.compress(packed[a:b]) for a, b in zip(edges, edges[1:])]
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(n)), pa.array(frames, type=pa.binary()), pa.array(n),
                     pa.array(np.full(len(n), tok.width))],
                    names=["doc_id", "frame", "n_tokens", "width"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = narrow.mapInArrow(compress, "doc_id long, frame binary, n_tokens long, width long")
    return materialise(coded.withColumn("row", F.monotonically_increasing_id()), "encoded")


def _system(folder: str):
    """(file system, path) of a folder given as a path or an address."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))


def _codec(dictionary: bytes) -> dict:
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write(encoded: DataFrame, folder: str, dictionary: bytes, shard: int = SHARD) -> DataFrame:
    """Write ``encoded`` (from ``encode`` with the same dictionary) to ``folder``; returns the index."""
    system, place = _system(folder)
    system.create_dir(place, recursive=True)
    with system.open_output_stream(f"{place}/dictionary") as file:
        file.write(dictionary)
    digest = hashlib.sha256(dictionary).digest()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _system(folder)
        number = TaskContext.get().partitionId()
        name = f"shard-{number:06d}-{uuid.uuid4().hex}.ids"
        file, at, before = None, HEADER, 0
        try:
            for batch in batches:
                if file is None:
                    file = system.open_output_stream(f"{place}/{name}")
                    file.write(MAGIC + bytes([batch.column(2)[0].as_py()]) + digest)
                frames = batch.column(1)
                file.write(b"".join(frames.to_pylist()))
                size = pc.binary_length(frames).to_numpy().astype(np.int64)
                n = batch.column(3).to_numpy()
                rows = len(batch)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(rows, number, dtype=np.int32)), pa.array([name] * rows), batch.column(0),
                    pa.array(at + np.cumsum(size) - size), pa.array(size), pa.array(n),
                    pa.array(before + np.cumsum(n) - n),
                ], names=["shard", "file", "doc_id", "at", "size", "n_tokens", "before"])
                at, before = at + int(size.sum()), before + int(n.sum())
        finally:
            if file is not None:
                file.close()

    total = encoded.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    order = ("doc_id", "row")
    ranged = encoded.select("doc_id", "frame", "width", "n_tokens", "row").repartitionByRange(
        math.ceil(max(total, 1) / shard), *order
    )
    rows = ranged.sortWithinPartitions(*order).drop("row").mapInArrow(shards, _INDEX_DDL)
    rows.write.mode("overwrite").parquet(f"{folder}/index")
    return index(encoded.sparkSession, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The index, with ``start``: the ids of all documents before each one."""
    rows = spark.read.schema(_INDEX_DDL).parquet(f"{folder}/index")
    # One row a shard: the running total over shards is small.
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).cast("long").alias("base"))
    return rows.join(base, "shard").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read(wanted: DataFrame, folder: str, checksum: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of index rows, from the files; ids are serialized as 32 bits.
    With ``checksum``, ``ids_crc32`` of these bytes stands in place of the ids."""
    column, kind, arrow = ("ids_crc32", "long", pa.int64()) if checksum else ("ids", "binary", pa.binary())

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        system, place = _system(folder)
        with system.open_input_stream(f"{place}/dictionary") as stream:
            dictionary = stream.read()
        digest = hashlib.sha256(dictionary).digest()
        unpacker = zstandard.ZstdDecompressor(**_codec(dictionary))
        name, file, width, held = None, None, 0, 0
        for batch in batches:
            at, size = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            names = batch.column(1).to_pylist()
            out, n, lo = [], [], 0
            while lo < len(names):
                if names[lo] != name:
                    if file is not None:
                        file.close()
                    name = names[lo]
                    file = system.open_input_file(f"{place}/{name}")
                    head = file.read_at(HEADER, 0)
                    if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) + 1 :] != digest:
                        raise ValueError(f"{name} is no id file of this folder's dictionary")
                    width = head[len(MAGIC)]
                # Frames that follow one another are read together, READ bytes or one frame at a time.
                hi = lo + 1
                while (hi < len(names) and names[hi] == name and at[hi] == at[hi - 1] + size[hi - 1]
                       and at[hi] + size[hi] - at[lo] <= READ):
                    hi += 1
                data = memoryview(file.read_at(int(at[hi - 1] + size[hi - 1] - at[lo]), int(at[lo])))
                for k in range(lo, hi):
                    raw = unpacker.decompress(data[at[k] - at[lo] : at[k] - at[lo] + size[k]])
                    ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
                    out.append(zlib.crc32(ids) if checksum else ids.tobytes())
                    n.append(len(ids))
                    held += ids.nbytes
                lo = hi
                if held > READ or lo == len(names):
                    done = lo - len(out)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(done, len(out)), batch.column(4).slice(done, len(out)),
                        pa.array(n, type=pa.int64()), pa.array(out, type=arrow),
                    ], names=["doc_id", "start", "n_tokens", column])
                    out, n, held = [], [], 0
        if file is not None:
            file.close()

    rows = wanted.select("shard", "file", "at", "size", "doc_id", "start")
    placed = rows.repartition("shard").sortWithinPartitions("shard", "at")
    return placed.select("doc_id", "file", "at", "size", "start").mapInArrow(
        frames, f"doc_id long, start long, n_tokens long, {column} {kind}"
    )


def fetch(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """``read`` of the documents whose doc_id is in ``ids``."""
    return read(index(spark, folder).join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), folder)


def write_documents(docs: DataFrame, path: str, folder: str, end: int = END, shard: int = SHARD) -> DataFrame:
    """Encode ``docs`` with the tokenizer at ``path`` and write them to ``folder``; returns the index."""
    dictionary = train(docs, path, end)
    return write(encode(docs, path, dictionary, end), folder, dictionary, shard)


@query("op11_id_files")
def id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written, read back and digested."""
    import public_tokenizers

    folder = scratch_path(spark, "id-files")
    rows = write_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read(rows, folder, checksum=True)
