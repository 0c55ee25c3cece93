"""Exact BPE encoding with a memo of chunks that cannot influence one another."""

from __future__ import annotations

import os
import re
import struct
from functools import cached_property, lru_cache

import numpy as np

#: Id that ends every document.
END_ID = 0
#: Most chunks that one Python worker remembers, and the longest chunk that it does.
MEMO_CHUNKS, MEMO_CHARS = 600_000, 48
# White space that binds to its neighbours: two together, one at an end of the text, or of another kind.
_BOUND = re.compile(r"\s\s|\A\s|\s\Z|[^\S \n]")
_FREE_SPACE = re.compile(r"(?<=\S) (?=\S)")
# A letter before ASCII marks (no apostrophe, which may start a contraction) ends a piece.
_TAIL = re.compile(r"(.*[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF])([!-&(-/:-@\[-^`{-~]+)", re.DOTALL)
_LETTERS = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
# Byte-level BPE shows a byte as itself if it is a visible Latin-1 character, the others as U+0100 on, in order.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _VISIBLE]
_SHOWN = {b: chr(b) if b in _VISIBLE else chr(256 + _HIDDEN.index(b)) for b in range(256)}


class _Memo(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit bytes.

    A chunk stands for itself after a space or, if it starts with a line feed,
    for itself alone.
    """

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self._encode, self._model = tokenizer.encode, tokenizer.model

    def bare(self, text: str) -> bytes:
        ids = self._encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, letters: str) -> bytes:
        """A space and letters are one piece of the pre-tokenizer, so the model alone encodes them."""
        shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_SHOWN)
        ids = [x.id for x in self._model.tokenize(_SHOWN[32] + shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        if (cut := _TAIL.fullmatch(chunk)) and "<|" not in chunk:
            ids = self[cut[1]] + self["\n" + cut[2]][len(self._feed) :]
        elif chunk[:1] == "\n":
            ids = self._feed + (self.bare(chunk[1:]) if len(chunk) > 1 else b"")
        else:
            ids = self.word(chunk) if _LETTERS.fullmatch(chunk) else self.bare(" " + chunk)
        if len(self) < MEMO_CHUNKS and len(chunk) <= MEMO_CHARS:
            self[chunk] = ids
        return ids

    @cached_property
    def _feed(self) -> bytes:
        return self.bare("\n")


class Encoder:
    """Encodes texts with a byte-level BPE file of the tokenizers library.

    The pre-tokenizer puts a boundary before every single space that stands
    between two non-space characters, and on both sides of such a line feed, so
    the chunks between them are encoded alone, once each, and joined: the ids
    equal those of the whole text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._memo = _Memo(self.tokenizer)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text (null: empty), without an end id."""
        if not text:
            return np.empty(0, "<u4")
        if _BOUND.search(text):
            chunks = _FREE_SPACE.split(text)  # only the first can start with white space
        else:
            chunks = text.replace("\n", " \n").split(" ")
        return np.frombuffer(self._memo.bare(chunks[0]) + b"".join(map(self._memo.__getitem__, chunks[1:])), "<u4")

    def document(self, text: str | None, end_id: int = END_ID) -> np.ndarray:
        return np.append(self.ids(text), np.uint32(end_id)).astype("<u4", copy=False)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
