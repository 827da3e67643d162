"""Token ids of whole texts by a public word-level BPE tokenizer, with caches per Python worker.

Pre-tokens of this tokenizer never cross white space, so a text's ids are the
ids of its white-space separated chunks, one after the other. Chunks are looked
up in a cache; misses go to the library itself. Texts that hold the tokenizer's
special strings need no detour: the library is given the chunk that holds them.
"""

from __future__ import annotations

import re

import numpy as np

# Unicode White_Space, which is what the tokenizer's \s means; str.split() also cuts at U+001C-U+001F.
_CHUNK = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_ODD = re.compile("[\x1c-\x1f]")
_CACHE_ENTRIES = 400_000
# The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for characters from U+0100 on.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_VISIBLE = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_open: dict[str, Encoder] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Misses(dict):
    """Chunk to little-endian 32-bit ids; a missing chunk is encoded by the library."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        self.words: dict[str, bytes] = {}

    def word(self, w: str) -> bytes:
        """Ids of a lower-case Latin word: one pre-token, which the model takes as visible characters for its bytes."""
        found = self.words.get(w)
        if found is None:
            shown = w if w.isascii() else w.encode().decode("latin1").translate(_VISIBLE)
            found = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            if len(self.words) >= _CACHE_ENTRIES:
                self.words.clear()
            self.words[w] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        body = chunk if chunk[-1] not in ".,!" else chunk[:-1]
        low = body.lower()
        if low.isalpha() and max(low) < "\u0250":
            found = self.word(low) if body is chunk else self.word(low) + self[chunk[-1]]
        else:
            found = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= _CACHE_ENTRIES:
            self.clear()
        self[chunk] = found
        return found


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunks = _Misses(self.tokenizer)

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _open:
            _open[path] = Encoder(path)
        return _open[path]

    @staticmethod
    def split(text: str) -> list[str]:
        return _CHUNK.findall(text) if _ODD.search(text) else text.split()

    def ids(self, text: str | None) -> bytes:
        """All ids of the text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        chunks = self.chunks
        return b"".join([chunks[c] for c in self.split(text)])
