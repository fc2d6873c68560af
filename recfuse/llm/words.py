"""Ids of whole texts under a BPE vocabulary whose tokens never cross white space.

Its normaliser (composition, lower case) and its pattern work inside stretches without white space,
so each stretch between spaces and line feeds is encoded by the tokenizers library on its own and
remembered, up to a fixed number of stretches.
"""

from __future__ import annotations

import re

import numpy as np

from recfuse.llm.bpe import LETTERS, Remembered, byte_alphabet, default_path

WORD_FILE = "word_bpe_49k.json"
#: Printable ASCII and the letters of Latin-1: composed already, lower case by single characters.
_PLAIN = re.compile(rf"[!-~{LETTERS}]+")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")


class WordCodec:
    def __init__(self, path: str | None = None, last: int | None = None):
        """last: an id appended to each document."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path(WORD_FILE))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.shown = self.tokenizer.model, {b: c for c, b in byte_alphabet().items()}
        self.last = b"" if last is None else np.array([last], "<u4").tobytes()
        self.known = Remembered(self._encode)

    def _encode(self, part: str) -> bytes:
        if not part:
            return b""
        if _PLAIN.fullmatch(part) and "<|" not in part:
            shown = ("".join(map(self.shown.__getitem__, w.encode())) for w in _WORDS.findall(part.lower()))
            ids = [t.id for w in shown for t in self.model.tokenize(w)]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" "))) + self.last
