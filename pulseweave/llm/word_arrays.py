"""Words of many texts as NumPy arrays of numbers, cut by Arrow without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are laid out at a time; a longer text is a step of its own.
STEP_BYTES = 8 << 20


def steps(sizes: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """(first, behind) of runs of texts with at most ``most`` bytes, or of one text."""
    upto = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(upto):
        done = upto[first - 1] if first else 0
        behind = max(first + 1, int(np.searchsorted(upto, done + most, side="right")))
        yield first, behind
        first = behind


def numbered_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, vocabulary, bounds): words are split at space and U+0009 to U+000D; those of text k are vocabulary[codes[bounds[k]:bounds[k + 1]]]; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    words = lists.flatten().dictionary_encode()
    codes, bounds = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(words.dictionary, "").as_py()  # beside leading and trailing white space
    if empty >= 0:
        real = codes != empty
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]]
        codes = codes[real]
    return codes, words.dictionary, bounds - bounds[0]


def owners(bounds: np.ndarray) -> np.ndarray:
    """The number of the text that each word belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def joined(codes: np.ndarray, vocabulary: pa.Array, bounds: np.ndarray) -> pa.Array:
    """Texts of words joined by a space."""
    words = vocabulary.take(pa.array(codes))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words), " ")
