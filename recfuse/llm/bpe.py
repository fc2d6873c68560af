"""Byte-pair encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never end up inside one token, so
a text may be cut between such a pair, its fragments encoded independently, and the ids concatenated.
Two kinds of cut are used, both also certain boundaries of the pattern that splits text before the
merges: a byte that is no white space before a space, and an ASCII letter before an ASCII byte that
is no letter. Fragments recur (most are words), so their ids are remembered up to a fixed number.

Null text counts as empty and gives no ids. Repeated rows give repeated rows. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recfuse.llm.common import lists, pairs_of, texts

#: Fragments a worker remembers, twice (older and newer ones), and the longest one; others are encoded anew.
REMEMBERED = 400_000
REMEMBERED_CHARS = 48

_FINE = re.compile(r"(?<=[A-Za-z])(?=[\x00-@\[-`{-\x7f])")
#: Characters for which Python's classes and the vocabulary's pattern surely agree.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf" ?[!-~{LETTERS}]+")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes follow from 256 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Remembered(dict):
    """Maps a fragment to its ids (little-endian unsigned 32-bit); fills itself by ``make``, forgets what is long unused."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key, self)
        if value is self:
            value = self.make(key)
        if len(key) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


@cache
def codec(kind: type, *args):
    """One codec per worker process: what it remembers serves its later tasks too."""
    return kind(*args)


class BpeCodec:
    """Encodes and decodes as the tokenizers library does with the given byte-level vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = [c for c in added.values()]
        alphabet = byte_alphabet()
        self.model, self.shown = self.tokenizer.model, {b: c for c, b in alphabet.items()}
        self.token_bytes: list[bytes] = [b""] * (max(self.tokenizer.get_vocab().values()) + 1)
        self.inside = np.zeros((256, 256), bool)
        for token, i in self.tokenizer.get_vocab().items():
            raw = added[i].encode() if i in added else bytes(alphabet[c] for c in token)
            self.token_bytes[i] = raw
            codes = np.frombuffer(raw, np.uint8)
            self.inside[codes[:-1], codes[1:]] = True
        self.after_space = Remembered(self._after_space)
        self.fragments = Remembered(self._fragment)

    def certain(self, left: str) -> bool:
        """Whether a text is certainly cut between ``left`` and a space that follows it."""
        return bool(left) and not left[-1].isspace() and not self.inside[left[-1].encode()[-1], 32]

    def _piece(self, piece: str) -> bytes:
        """Ids of a stretch that the pattern treats on its own."""
        if _PLAIN.fullmatch(piece):
            shown = ("".join(map(self.shown.__getitem__, w.encode())) for w in _WORDS.findall(piece))
            ids = [t.id for w in shown for t in self.model.tokenize(w)]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _fragment(self, fragment: str) -> bytes:
        if any(s in fragment for s in self.special):
            return np.array(self.tokenizer.encode(fragment, add_special_tokens=False).ids, "<u4").tobytes()
        cuts = [m.start() for m in _FINE.finditer(fragment)]
        cuts = [c for c in cuts if not self.inside[ord(fragment[c - 1]), ord(fragment[c])]]
        edges = [0, *cuts, len(fragment)]
        return b"".join(self._piece(fragment[a:b]) for a, b in zip(edges, edges[1:], strict=False))

    def _after_space(self, part: str) -> bytes | None:
        """Ids of a space and ``part``; None if the text after it isn't certainly cut."""
        return self._fragment(f" {part}") if self.certain(part) else None

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        first, *rest = text.split(" ")
        if not rest or self.certain(first):
            try:
                return np.frombuffer(self.fragments[first] + b"".join(map(self.after_space.__getitem__, rest)), "<u4")
            except TypeError:  # a None: some space follows white space or an uncertain byte
                pass
        found, open_parts = [], [first]
        for part in rest:
            if self.certain(open_parts[-1]):
                found.append(self.fragments[" ".join(open_parts)])
                open_parts = ["", part]
            else:
                open_parts.append(part)
        found.append(self.fragments[" ".join(open_parts)])
        return np.frombuffer(b"".join(found), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""
    path = path or default_path("byte_bpe_50k.json")

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = codec(BpeCodec, path)
        for keys, rows in pairs_of(batches, "doc_id", "text"):
            found = [own.encode(t) for t in rows]
            offsets = np.cumsum([0, *map(len, found)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists(offsets, np.concatenate(found).astype(np.int32))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of every row of ids; bytes that are no UTF-8 become U+FFFD."""
    path = path or default_path("byte_bpe_50k.json")

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = codec(BpeCodec, path)
        for keys, rows in pairs_of(batches, "doc_id", "ids"):
            found = [own.decode(np.array(r or [], "<u4")) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    path = path or default_path("byte_bpe_50k.json")

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = codec(BpeCodec, path)
        decimal = [str(i).encode() for i in range(len(own.token_bytes))]
        for keys, rows in pairs_of(batches, "doc_id", "text"):
            counts, id_digests, text_digests = [], [], []
            for text in rows:
                ids = own.encode(text)
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids.tolist()))).hexdigest())
                text_digests.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
