"""Token ids of whole texts by the tokenizers library, with caches that keep repeated words from being encoded again.

The vocabulary's rules never reach across space and U+0009 to U+000D: the
normalizer turns white space into a space, the split pattern drops it, and
merges stay inside what the pattern cuts out. So the ids of a text are those
of its chunks between such characters. A chunk of plain Latin letters is cut
by the vocabulary's own pattern and its pieces go to the library's BPE model;
any other chunk, and any text with a special token's string, goes through the
library whole. ``ids`` equals ``Tokenizer.encode(text,
add_special_tokens=False).ids`` for every text.

``batch`` does the same for an Arrow array of texts at once: Arrow lower-cases,
splits and numbers the chunks, every distinct chunk is encoded once, and NumPy
lays the ids out in order of the texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: What the fast way covers: printable ASCII and Latin letters, of which none composes with another.
PLAIN = re.compile(r"[\x21-\x7eÀ-įĲ-ž]*")
#: ASCII marks without the apostrophe: letters with such marks behind are two pieces by any reading of the pattern.
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
MOST_CACHED = 1_000_000
LONGEST_CACHED = 48
#: Bytes of text that are laid out at a time (a longer text is a step of its own): bounds the arrays of ``batch``.
STEP_BYTES = 8 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter for each byte in byte-level vocabularies: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].lower().encode() for t in spec["added_tokens"]]
        #: what is remembered, in two generations: when the younger is full it becomes the older, and what is used again comes back from there
        self.chunks: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        split = [s for s in spec["pre_tokenizer"].get("pretokenizers", []) if s["type"] == "Split"] if spec.get("pre_tokenizer") else []
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        #: the cache is right only for the kind of vocabulary described above
        self.cached = kinds == ["NFC", "Replace", "Lowercase"] and len(split) == 1 and split[0]["invert"] and spec["model"]["type"] == "BPE"
        if self.cached:
            self.find = regex.compile(split[0]["pattern"]["Regex"]).findall
            self.letters = byte_letters()
            self.as_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def whole(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> bytes:
        """Ids of what the vocabulary's pattern cuts out as one piece."""
        mapped = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return b"".join([self.as_bytes[t.id] for t in self.model.tokenize(mapped)])

    def chunk(self, chunk: bytes) -> bytes:
        """Ids of a chunk that is not in the younger generation, or was not when its caller looked."""
        found = self.chunks.get(chunk)
        if found is None and (found := self.older.get(chunk)) is None:
            found = self.made(chunk)
        if len(chunk) <= LONGEST_CACHED:
            if len(self.chunks) >= MOST_CACHED // 2:
                self.older, self.chunks = self.chunks, {}
            self.chunks[chunk] = found
        return found

    def made(self, chunk: bytes) -> bytes:
        """Ids of a chunk, encoded."""
        text = chunk.decode()
        if not PLAIN.fullmatch(text):
            return self.whole(text)
        if (text := text.lower()).isalpha():
            return self.piece(text)
        if (word := text.rstrip(MARKS)).isalpha():
            own, marks = word.encode(), text[len(word) :].encode()
            return (self.chunks.get(own) or self.chunk(own)) + (self.chunks.get(marks) or self.chunk(marks))
        return b"".join(map(self.piece, self.find(text)))

    def ids(self, text: str) -> bytes:
        # the vocabulary lower-cases, so A-Z may be lower-cased before: fewer chunks differ
        raw = text.encode().lower()
        if not self.cached or any(s in raw for s in self.special):
            return self.whole(text)
        get, miss = self.chunks.get, self.chunk
        return b"".join([get(c) or miss(c) for c in raw.split()])

    def batch(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, behind, ids, ends) of runs of texts without nulls: all ids of the texts from ``first`` on, and where each text's end."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(texts):
            done = sizes[first - 1] if first else 0
            behind = max(first + 1, int(np.searchsorted(sizes, done + STEP_BYTES, side="right")))
            yield first, behind, *self._laid_out(texts.slice(first, behind - first))
            first = behind

    def _laid_out(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lowered = pc.ascii_lower(texts.cast(pa.string()))
        apart = np.full(len(texts), not self.cached)
        for s in self.special:
            apart |= pc.match_substring(lowered, s.decode()).to_numpy(zero_copy_only=False)
        if apart.any():
            lowered = pc.if_else(pa.array(apart), "", lowered)
        lists = pc.ascii_split_whitespace(lowered)
        chunks = lists.flatten().dictionary_encode()
        _, places, data = chunks.dictionary.buffers()
        data, places = data.to_pybytes() if data else b"", np.frombuffer(places, np.int32)[: len(chunks.dictionary) + 1].tolist()
        get, miss = self.chunks.get, self.chunk
        found = [get(c) or miss(c) for c in (data[a:b] for a, b in zip(places, places[1:], strict=False))]
        table, lengths = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int32, len(found)) // 4
        code = chunks.indices.to_numpy(zero_copy_only=False)
        each = lengths[code]
        ends = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        # the k-th id of a chunk's occurrence is the k-th behind the chunk's first one in the table
        ids = table[np.repeat((np.cumsum(lengths) - lengths)[code] - ends[:-1], each) + np.arange(ends[-1])]
        bounds = ends[lists.offsets.to_numpy(zero_copy_only=False)]
        if not apart.any():
            return ids, bounds[1:]
        parts = [np.frombuffer(self.whole(texts[k].as_py()), "<u4") if own else ids[bounds[k] : bounds[k + 1]] for k, own in enumerate(apart)]
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)
