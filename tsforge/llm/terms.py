"""Exact term counts of Arrow string batches.

Terms are maximal runs of bytes outside a separator table (separators are ASCII, so no character
is cut), with A-Z folded. Terms are told apart by their bytes, through Arrow's dictionary
encoding, never by a hash alone. Null text has no terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tsforge.llm import text as tx

#: Separators of `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`: everything ASCII but letters.
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
#: Separators of `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`: everything ASCII but letters and digits.
NOT_LETTER_OR_DIGIT = tx.PUNCTUATION


@dataclass
class Terms:
    """Tokens of a slice of texts: the text and the term (an index of ``names``) of each."""

    first: int
    docs: int
    doc: np.ndarray
    term: np.ndarray
    names: pa.Array

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, occurrences) for each term of each text, ordered by term, then text."""
        key, n = np.unique(self.term * np.int64(max(self.docs, 1)) + self.doc, return_counts=True)
        return key % max(self.docs, 1), key // max(self.docs, 1), n


def packed_words(raw: np.ndarray, w: tx.Words) -> pa.Array:
    """The words as a string array."""
    size = w.end - w.start
    at = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=at[1:])
    take = np.repeat(w.start - at[:-1], size) + np.arange(at[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(raw[take]))


def slices(column: pa.Array, separator: np.ndarray, size: int, fold: bool = True) -> Iterator[Terms]:
    """Terms of runs of rows of about ``size`` bytes; a longer text is a run of its own."""
    for first, raw, offsets in tx.slices(column, size):
        if fold:
            raw = tx._LOWER[raw]
        w = tx.words(raw, offsets, separator)
        coded = packed_words(raw, w).dictionary_encode()
        yield Terms(first, len(offsets) - 1, w.doc, coded.indices.to_numpy().astype(np.int64), coded.dictionary)
