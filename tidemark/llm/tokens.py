"""Token ids of a public byte-level vocabulary, word by word."""

from __future__ import annotations

import base64
import re
import sys
from array import array

import public_tokenizers

VOCABULARY = "byte_bpe_50k"
#: A worker forgets the encoded words beyond so many.
REMEMBERED = 300_000
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
_JOINED_SPACE = re.compile(r"\s | \s|^ | $")


class WordCoder:
    """Token ids as little-endian 32-bit words: the ids of the vocabulary's .json file, by the same vocabulary's ranks.

    A space between two characters that are no white space always starts a new unit of the vocabulary's word rule, so the
    text may be cut there and every piece encoded once and remembered. Texts with other spaces are encoded whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY, remembered: int = REMEMBERED):
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def _whole(self, text: str) -> bytes:
        ids = array("I", self.encode(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _plain(self, text: str) -> bytes:
        if not text or _JOINED_SPACE.search(text):
            return self._whole(text)
        first, *words = text.split(" ")
        known, out = self.known, [self._whole(first)]
        for w in words:
            ids = known.get(w)
            if ids is None:
                if len(known) >= self.remembered:
                    known.clear()
                ids = self._whole(" " + w)
                if len(w) <= 64:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            return SPECIAL_ID.to_bytes(4, "little").join(map(self._plain, text.split(SPECIAL)))
        return self._plain(text)


def coder(vocabulary: str = VOCABULARY) -> WordCoder:
    """One per worker process."""
    if vocabulary not in _CODERS:
        _CODERS[vocabulary] = WordCoder(vocabulary)
    return _CODERS[vocabulary]


_CODERS: dict[str, WordCoder] = {}
