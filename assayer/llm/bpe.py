"""Cached byte-pair encoding of whole texts, and what token counts and packing need of it.

The pre-tokenizer of this vocabulary always starts a new token at a space that a non-space follows, so a text
can be cut there and its pieces encoded on their own. Pieces repeat, so each worker keeps a bounded cache of
what it needs of a piece. Texts with double or outer spaces, or with the end-of-text mark, are encoded whole.
Ids equal those that the tokenizers library gives from the JSON file of the same vocabulary, which tests hold
them against.
"""

from __future__ import annotations

import base64
import sys
from array import array
from functools import lru_cache

import numpy as np
import tiktoken

MARK = "<|endoftext|>"
#: Fixed values of the public vocabulary: the pre-tokenizer's pattern and the mark's id.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK_ID = 50256


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={MARK: MARK_ID})


class _Pieces(dict):
    """Encoded pieces, made on first use; starts anew when it holds ``most``."""

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        made = self[piece] = self.encode(piece)
        return made


class Encoder:
    """``ids`` gives a text's ids as little-endian uint32 bytes, ``lengths`` its tokens' UTF-8 bytes as uint16."""

    def __init__(self, path: str, cache: int = 400_000):
        self.bpe = encoding(path)
        sizes = np.zeros(self.bpe.n_vocab, np.uint16)
        for i in range(MARK_ID):
            sizes[i] = len(self.bpe.decode_single_token_bytes(i))
        sizes[MARK_ID] = len(MARK)
        self.sizes = sizes
        self._ids = _Pieces(lambda piece: self._whole(" " + piece), cache)
        self._lengths = _Pieces(lambda piece: self._sizes(" " + piece), cache)

    def _encode(self, text: str) -> list[int]:
        return self.bpe.encode(text, allowed_special="all") if MARK in text else self.bpe.encode_ordinary(text)

    def _whole(self, text: str) -> bytes:
        ids = array("I", self._encode(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _sizes(self, text: str) -> bytes:
        return self.sizes[np.array(self._encode(text), np.int64)].tobytes()

    @staticmethod
    def _plain(text: str) -> bool:
        return not (text[:1] == " " or text[-1:] == " " or "  " in text or MARK in text)

    def _each(self, text: str, whole, pieces: _Pieces) -> bytes:
        if not self._plain(text):
            return whole(text)
        first, *rest = text.split(" ")
        return whole(first) + b"".join(map(pieces.__getitem__, rest))

    def ids(self, text: str) -> bytes:
        return self._each(text, self._whole, self._ids)

    def lengths(self, text: str) -> np.ndarray:
        return np.frombuffer(self._each(text, self._sizes, self._lengths), np.uint16)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path)
