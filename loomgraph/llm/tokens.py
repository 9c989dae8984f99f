"""Token ids of whole texts by a public tokenizer file, with a bounded cache of pieces.

The tokenizer lower-cases a text, drops white space and cuts the rest by a pattern into pieces that it
encodes on their own, so the ids of a text are those of its pieces in a row. A text of common letters
is cut whole by that pattern here, and each distinct piece is encoded once in a worker; any other text
is cut at white space, and the library encodes what stands between.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import pyarrow as pa

#: Fixed value: the cutting pattern of the word tokenizer is
#: 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+
ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
#: Up to this code point every character is in composed form and has a lower case of its own, but for U+0130.
LAST_PLAIN = 0x24F
NOT_LOWERED = "İ"
MOST_PIECES = 600_000
MOST_CHUNKS = 100_000
#: Longer keys are not kept.
LONG = 200


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte: itself if it is printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def char_class(test) -> str:
    """The common characters, as they are and lower-cased, that pass a test, for a pattern's class."""
    common = [chr(k) for k in range(LAST_PLAIN + 1) if chr(k) != NOT_LOWERED]
    return "".join(re.escape(c) for c in sorted({*common, *"".join(common).lower()}) if test(c))


class Cache(dict):
    """Values by key, made where missing. When it is full the older half goes: what was not asked for since the last time."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most // 2, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONG:
            return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Encodes as ``Tokenizer.encode(text, add_special_tokens=False)`` does, special strings being plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        self.letters = byte_letters()
        white = "\\t-\\r \x85\xa0"
        letter = char_class(str.isalpha)
        number = char_class(lambda c: c.isnumeric())
        self.odd = re.compile(f"[^\\t-\\r\\x20-{chr(LAST_PLAIN)}]|{NOT_LOWERED}").search
        self.cut = re.compile(f"[{letter}]+|{ENDINGS}|[{number}]|[^{white}{letter}{number}]+").findall
        self.pieces = Cache(self._piece, MOST_PIECES)
        self.chunks = Cache(self._chunk, MOST_CHUNKS)

    def _chunk(self, chunk: bytes) -> bytes:
        return array("I", self.library.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """A lower-cased piece by the library's model alone: its normaliser and cutting have nothing left to do."""
        if not (piece.isascii() and piece.isalnum()):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def one(self, raw: bytes) -> bytes:
        text = raw.decode()
        if self.odd(text):
            return b"".join(map(self.chunks.__getitem__, raw.split()))
        return b"".join(map(self.pieces.__getitem__, self.cut(text.lower())))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text, as little-endian unsigned 32-bit integers."""
        return [self.one(x) for x in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    return WordEncoder(path)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null is empty."""
    return [x if x is not None else b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
