"""Vectorised text helpers for Arrow batches; everything here works on one batch at a time."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that one step works on at a time; longer texts are a step of their own.
STEP_CHARS = 4_000_000


@dataclass
class Words:
    """The words of a batch, in order: doc (index in the batch) and code (index in vocabulary) of each word."""

    doc: np.ndarray
    code: np.ndarray
    vocabulary: pa.Array
    docs: int

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)


def words_of(texts: pa.Array, separators: str | None = None) -> Words:
    """Words between ASCII white space (or the pieces between `separators`), A-Z in lower case. Null: no words."""
    lowered = pc.ascii_lower(texts)  # not cast to large_string: that goes wrong for slices of an array
    split = pc.ascii_split_whitespace(lowered) if separators is None else pc.split_pattern(lowered, separators)
    doc, flat = pc.list_parent_indices(split), pc.list_flatten(split)
    real = pc.greater(pc.binary_length(flat), 0)
    encoded = flat.filter(real).dictionary_encode()
    return Words(doc.filter(real).to_numpy(zero_copy_only=False), encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary, len(texts))


def sorted_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each begins in sorted order, and how often it occurs."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ordered = np.sort(keys)
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[starts], starts, np.diff(np.append(starts, len(ordered)))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal outputs, near ones unrelated ones."""
    x = (x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit_interval(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def steps(lengths: np.ndarray, most: int = STEP_CHARS) -> list[tuple[int, int]]:
    """Ranges of consecutive documents of about `most` characters in all."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += int(n)
    return [*out, (begin, len(lengths))] if begin < len(lengths) else out


def sliced(batch: pa.RecordBatch, most: int = STEP_CHARS, column: str = "text") -> list[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text, so that a task's memory doesn't depend on the batch size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    return [batch.slice(a, b - a) for a, b in steps(sizes, most)]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts one after the other, and the document of each."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    return points, np.repeat(np.arange(len(texts)), lengths)


@lru_cache(1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)
