"""Words and shingles of a text, as byte strings: bytes.split() splits at exactly the characters space and U+0009 to U+000D."""

from __future__ import annotations

import numpy as np
import xxhash

SPACES = " \t\n\x0b\x0c\r"


def shingle_hashes(text: str, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, A-Z lower-cased, joined by single spaces; of the whole sequence if it is shorter; empty without words."""
    words = text.encode().lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip((ends - lengths)[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of ``hashes``; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 65536):  # bounded memory for long texts
        ones += np.unpackbits(hashes[part : part + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in a window of ``width`` words that occurs twice or more."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n)
    if len(seen) > n - width:  # too few repeated words for a repeated window
        return 0
    mixed = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        # odd multipliers far apart (SplitMix64 steps); distinct windows of small ids meet with odds of about 2**-64 a pair
        z = (0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1)
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        mixed += ids[k : n - width + 1 + k] * np.uint64(z | 1)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    twice = np.zeros(len(mixed), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())
