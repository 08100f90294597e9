"""Token ids of texts by a public tokenizer, with a bounded cache of pieces.

The library's own encoding spends most of its time on splitting. Text of Latin letters,
digits, ASCII signs, spaces and line ends is split here, at spaces and line ends, where the
tokenizer's pattern always splits; pieces seen before come from a cache, others are split by
the same pattern and encoded by the library's model. Any other text goes to the library whole.
``tests/llm`` holds both routes against each other.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[ \n!-~{_LETTERS}]*")
_PARTS = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \n0-9{_LETTERS}]+|[ \n]+(?![^ \n])|[ \n]+"
)
CACHED = 400_000  # pieces


def _byte_letters() -> dict[int, str]:
    """The tokenizer's letter for each byte: printable Latin-1 characters stand for themselves,
    all others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Texts to ids, packed as unsigned 16-bit numbers (or 32-bit, for larger vocabularies)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._model = self._library.model
        self.kind = np.dtype("<u2" if self._library.get_vocab_size() <= 1 << 16 else "<u4")
        self._letters = str.maketrans(_byte_letters())
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._small: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self._small.get(part)
        if found is None:
            letters = part.encode().decode("latin-1").translate(self._letters)
            found = np.array([t.id for t in self._model.tokenize(letters)], self.kind).tobytes()
            if len(self._small) >= CACHED:
                self._small.clear()
            self._small[part] = found
        return found

    def _piece(self, piece: str) -> bytes:
        found = b"".join(map(self._part, _PARTS.findall(piece)))
        if len(self._pieces) >= CACHED:
            self._pieces.clear()
        self._pieces[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        spaced = text.replace("\n", " \n")
        if (
            not text or text[0] in " \n" or "  " in spaced or "\n\n\n" in text or text.endswith(("\n\n", " "))
            or not _PLAIN.fullmatch(text) or any(s in text for s in self._special)
        ):
            return np.array(self._library.encode(text, add_special_tokens=False).ids, self.kind).tobytes() if text else b""
        known, piece = self._pieces, self._piece
        first, *rest = spaced.split(" ")
        out = [self._piece(first)]
        for chunk in rest:
            key = chunk if chunk[0] == "\n" else " " + chunk
            out.append(known.get(key) or piece(key))
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(name: str = TOKENIZER) -> Encoder:
    """The encoder of this process for a file of the public tokenizers, or for a path."""
    if os.path.sep not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Encoder(name)


def crc32(ids: bytes, kind: np.dtype) -> int:
    """Checksum of ids as little-endian unsigned 32-bit numbers."""
    import zlib

    return zlib.crc32(np.frombuffer(ids, kind).astype("<u4").tobytes())
