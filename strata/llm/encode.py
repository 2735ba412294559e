"""Whole-text BPE encoding with a per-worker memo of word ids.

The vocabulary drops white space and ends every piece with a word-end mark, so the ids
of a text are the ids of its white-space separated chunks, in order. A chunk of plain
Latin letters, digits and ASCII signs is cut into the pieces the pre-tokenizer would cut
and each piece goes to the library's BPE model once; any other chunk, and any text with
separators on which Python and the library may disagree, goes to the library whole.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_DISAGREE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_PLAIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PIECES = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_LOADED: dict[str, "Encoder"] = {}


def _byte_names() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 upwards."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    names = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + k)
    return names


class Encoder:
    """encode(text) -> ids as bytes of `dtype`. The memo is bounded by max_words entries."""

    def __init__(self, path: str, max_words: int = 600_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        top = max(self.tok.get_vocab(with_added_tokens=True).values())
        self.dtype = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
        self.model, self.names = self.tok.model, _byte_names()
        self.memo: dict[str, bytes] = {}
        self.max_words = max_words

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self.memo.get(piece)
        if got is None:
            as_bytes = piece if piece.isascii() else "".join(self.names[b] for b in piece.encode())
            got = np.array([t.id for t in self.model.tokenize(as_bytes)], self.dtype).tobytes()
            if len(self.memo) < self.max_words:
                self.memo[piece] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk and unicodedata.is_normalized("NFC", chunk):
            low = chunk.lower()
            pieces = _PIECES.findall(low)
            got = self._piece(low) if len(pieces) == 1 else b"".join(map(self._piece, pieces))
        else:
            got = self._whole(chunk)
        if len(self.memo) < self.max_words and len(chunk) <= 64:
            self.memo[chunk] = got
        return got

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _DISAGREE.search(text):
            return self._whole(text)
        get, slow = self.memo.get, self._chunk
        return b"".join([get(w) or slow(w) for w in text.split()])


def load(path: str) -> Encoder:
    """The worker's encoder for this vocabulary; tasks of one worker share its memo."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
