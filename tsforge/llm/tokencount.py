"""Token counts of a piece vocabulary by rank-synchronous merging of arrays.

The pre-tokens of a batch (runs of the space mark and what follows; no piece of such a
vocabulary goes on across a space mark) lie in ragged numpy arrays: one symbol per character,
the sequence each belongs to, and the rank of the pair each symbol forms with the next. Every
step finds the lowest rank of each sequence, merges that pair in all sequences at once and drops
sequences that have no pair left. The count is what survives; a character outside the vocabulary
counts its UTF-8 bytes (byte fallback).

The library merges one pair at a time, best score first and leftmost among equals. Occurrences
of the lowest pair of a sequence are merged together only up to the first one whose merge would
form a pair of the same or a better rank; the step ends there, so the outcome is the same.

Defined results: null text counts as empty: 0 bytes, 0 tokens. Rows map one to one, so ties,
repeated rows, empty tables and extra columns are harmless. A word of any length is handled by
the arrays; equal pairs in it merge in one step.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm.base import query, table

MARK = "▁"
NONE = np.int32(np.iinfo(np.int32).max)
#: Pre-tokens kept between batches, symbols merged at once, characters of a slice of documents.
CACHE, SYMBOLS, CHARS = 300_000, 1 << 20, 1 << 22
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")


class Merges:
    """Symbols and pair ranks of one model, with a vectorised lookup of pairs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        if not any(model.is_byte(i) for i in range(size)):
            raise ValueError("the model has no byte pieces")
        ids = {
            model.id_to_piece(i): i
            for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        }
        if any(MARK in piece.lstrip(MARK) for piece in ids):
            raise ValueError("a piece goes on across a space mark")
        scores = {i: model.get_score(i) for i in ids.values()}
        rank_of = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.symbol = np.full(0x110000, -1, dtype=np.int32)
        self.pieces = size
        # Characters that occur only inside pieces can merge but are no piece themselves.
        symbols = dict(ids)
        for piece in ids:
            for char in piece:
                symbols.setdefault(char, size + len(symbols) - len(ids))
        for text, i in symbols.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i
        self.width = max(symbols.values()) + 1
        table_ = {
            symbols[piece[:k]] * self.width + symbols[piece[k:]]: (rank_of[scores[i]], i)
            for piece, i in ids.items()
            for k in range(1, len(piece))
            if piece[:k] in symbols and piece[k:] in symbols
        }
        self._build(table_)

    def _build(self, pairs: dict[int, tuple[int, int]]) -> None:
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        value = np.array(list(pairs.values()), dtype=np.int32).reshape(-1, 2)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank = np.full(1 << self.bits, NONE, dtype=np.int32)
        self.piece = np.full(1 << self.bits, -1, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.key[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            at, who = slot[placed], todo[placed]
            self.key[at], self.rank[at], self.piece[at] = keys[who], value[who, 0], value[who, 1]
            left = np.ones(len(todo), dtype=bool)
            left[placed] = False
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        scattered = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (scattered >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of each pair of symbols; NONE where they do not merge."""
        key = left.astype(np.int64) * self.width + right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        got = self.key[slot]
        rank = np.where(got == key, self.rank[slot], NONE)
        piece = self.piece[slot]
        open_ = np.flatnonzero((got != key) & (got >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = slot[open_]
            got = self.key[at]
            hit = got == key[open_]
            rank[open_[hit]] = self.rank[at[hit]]
            piece[open_[hit]] = self.piece[at[hit]]
            open_ = open_[~hit & (got >= 0)]
        return rank, piece

    def counts(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each word."""
        out = np.zeros(len(words), dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        first = 0
        while first < len(words):
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + SYMBOLS, side="right")))
            out[first:last] = self._merge(words[first:last], sizes[first:last])
            first = last
        return out

    def _merge(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        sym = self.symbol[code]
        byte_length = 1 + (code >= 0x80).astype(np.int32) + (code >= 0x800) + (code >= 0x10000)
        weight = np.where((sym >= 0) & (sym < self.pieces), 1, byte_length).astype(np.int64)
        seq = np.repeat(np.arange(len(words)), sizes)
        out = np.zeros(len(words), dtype=np.int64)
        if not len(sym):
            return out
        rank, piece = self._pairs(sym, seq)
        while len(sym):
            start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            length = np.diff(np.r_[start, len(seq)])
            best = np.minimum.reduceat(rank, start)
            done = best == NONE
            if done.any():
                out[seq[start[done]]] = np.add.reduceat(weight, start)[done]
                keep = np.repeat(~done, length)
                sym, weight, seq, rank, piece = sym[keep], weight[keep], seq[keep], rank[keep], piece[keep]
                if not len(sym):
                    break
                best, length = best[~done], length[~done]
            at = np.flatnonzero(rank == np.repeat(best, length))
            # Of overlapping occurrences every other one, from the left.
            run = np.r_[True, np.diff(at) != 1]
            place = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[place % 2 == 0]
            at = self._up_to_better(at, sym, seq, rank, piece)
            sym[at], weight[at] = piece[at], 1
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            sym, weight, seq, rank, piece = sym[keep], weight[keep], seq[keep], rank[keep], piece[keep]
            touched = np.union1d(at, at[at > 0] - 1)
            after = np.minimum(touched + 1, len(sym) - 1)
            r, p = self.find(sym[touched], sym[after])
            r[(touched == after) | (seq[touched] != seq[after])] = NONE
            rank[touched], piece[touched] = r, p
        return out

    def _pairs(self, sym: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.full(len(sym), NONE, dtype=np.int32)
        piece = np.full(len(sym), -1, dtype=np.int32)
        rank[:-1], piece[:-1] = self.find(sym[:-1], sym[1:])
        rank[:-1][seq[1:] != seq[:-1]] = NONE
        return rank, piece

    def _up_to_better(self, at, sym, seq, rank, piece) -> np.ndarray:
        """Of several occurrences in a sequence, those up to the first that forms a better pair."""
        where = seq[at]
        several = np.r_[False, where[1:] == where[:-1]]
        several[:-1] |= several[1:]
        if not several.any():
            return at
        many = at[several]
        owner, limit = seq[many], rank[many]
        merged = piece[many]
        beside = np.r_[False, (many[1:] - many[:-1] == 2) & (owner[1:] == owner[:-1])]
        before = np.maximum(many - 1, 0)
        left = np.where(beside, np.r_[merged[:1], merged[:-1]], sym[before])
        has_left = (many > 0) & (seq[before] == owner)
        after = np.minimum(many + 2, len(sym) - 1)
        has_right = (many + 2 < len(sym)) & (seq[after] == owner)
        better = has_left & (self.find(left, merged)[0] <= limit)
        better |= has_right & (self.find(merged, sym[after])[0] <= limit)
        if not better.any():
            return at
        # An occurrence stays while no earlier one of its sequence formed a better pair.
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        seen = np.cumsum(better) - better
        seen -= np.repeat(seen[start], np.diff(np.r_[start, len(many)]))
        stay = np.ones(len(at), dtype=bool)
        stay[np.flatnonzero(several)[seen > 0]] = False
        return at[stay]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def _cache(path: str) -> dict[str, int]:
    return {}


def pretokens(text: str) -> list[str]:
    """The text's pre-tokens, each without its first space mark."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] for run in _RUNS.findall(MARK + text.replace(" ", MARK))]


def count_texts(texts: Iterable[str | None], path: str) -> np.ndarray:
    """Tokens of each text."""
    model, known = merges(path), _cache(path)
    out: list[int] = []
    waiting: list[list[str]] = []
    chars = 0

    def flush() -> None:
        fresh = list(set().union(*waiting).difference(known))
        if len(known) + len(fresh) > CACHE:
            known.clear()
            fresh = list(set().union(*waiting))
        known.update(zip(fresh, model.counts([MARK + word for word in fresh]).tolist()))
        out.extend(sum(map(known.__getitem__, words)) for words in waiting)
        waiting.clear()

    for text in texts:
        waiting.append(pretokens(text or ""))
        chars += len(text or "")
        if chars > CHARS:
            flush()
            chars = 0
    if waiting:
        flush()
    return np.array(out, dtype=np.int64)


def token_count(path: str, text: Column) -> Column:
    """Column expression: tokens of a text under the model at ``path``."""

    @F.arrow_udf("long")
    def count_tokens(column: pa.Array) -> pa.Array:
        return pa.array(count_texts((t.as_py() for t in column), path), type=pa.int64())

    return count_tokens(text)


@query("op4_token_counts")
def token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn("n_tokens", token_count(public_tokenizers.path("piece_bpe_32k.model"), F.col("text")))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
