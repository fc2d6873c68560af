"""Byte-level BPE by a transducer whose states are made when a text first reaches them.

The merges encode a stretch of bytes as the one sequence of tokens in which every token may follow
the one before it: the merges of the two tokens' bytes alone give just these two (``follows``).
A nondeterministic machine therefore reads bytes along the trie of all tokens; at the end of a token
that may follow, it returns to the root and writes it. The set of its positions after some bytes is
one state of the deterministic machine: for each open token its node, the token before it, and the
tokens written but not yet certain. What all positions have in common is emitted with the step, so
output waits for as many bytes at most as the longest token has. States and steps are made when
needed and forgotten when there are ``STATES`` of them, which costs time only.

Decoding is a machine too: its state is the unfinished UTF-8 character (three bytes at most), and
each token moves it to another and emits the finished text.

A text is split by the vocabulary's pattern first, and each match is encoded on its own; a match
that is itself a token is that token. Null text counts as empty and gives no ids. Very long texts
and matches are read byte by byte with the same bounded state. Repeated rows give repeated rows, an
empty table gives no rows, and columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import codecs
import contextlib
import gc
import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recfuse.llm.bpe import LETTERS, Remembered, codec, default_path
from recfuse.llm.common import lists, pairs_of, texts

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: States, remembered pairs of tokens, and remembered decoding steps of a worker.
STATES = 300_000
PAIRS = 800_000

_PLAIN = re.compile(rf"[\n -~{LETTERS}]*")


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@cache
def _members(name: str) -> tuple[frozenset[str], str]:
    """Characters of a class as the pattern's own library sees it, and all characters."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    library = tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return frozenset(library.decode(library.encode_ordinary(every))), every


def _ranges(chars: Iterable[str]) -> str:
    """The characters as ranges of a regex class."""
    found: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if found and code == found[-1][1] + 1:
            found[-1][1] = code
        else:
            found.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


def split_pattern(pattern: str) -> str:
    """The pattern with its classes spelled so that the regex module reads them as the pattern's own library does.

    Both know the same syntax, but maybe other versions of Unicode: characters that only one of them
    counts to a class are taken out of or added to it.
    """
    import regex

    inside = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        theirs, every = _members(name)
        own = set(regex.findall(name, every))
        more, less = _ranges(theirs - own), _ranges(own - theirs)
        inside[name] = f"[{name}{more}]" if not less else f"[[{name}{more}]--[{less}]]"
    if all(v == f"[{k}]" for k, v in inside.items()):
        return pattern
    spelled = {r"[^\s\p{L}\p{N}]": f"[^{''.join(inside.values())}]", r"\S": f"[^{inside[r'\s']}]"} | inside
    return "(?V1)" + regex.sub("|".join(map(regex.escape, spelled)), lambda m: spelled[m[0]], pattern)


class State(dict):
    """Maps a byte to what it emits and the state after it; makes the step when it is first asked for.

    positions: (node, token before, tokens written but not certain); last: what ends a stretch here.
    """

    __slots__ = ("machine", "positions", "last")

    def __init__(self, machine: Transducer, positions: tuple[tuple[int, int, tuple[int, ...]], ...]):
        self.machine, self.positions = machine, positions
        self.last = () if positions[-1][0] else positions[-1][2]

    def __missing__(self, byte: int) -> tuple[tuple[int, ...], State]:
        step = self[byte] = self.machine.step(self.positions, byte)
        return step


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.raw = {rank: token for token, rank in ranks.items()}
        #: The trie: child of (node, byte), token that ends at a node or -1, whether it has children. The root is 0.
        self.children: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                child = self.children.get(node << 8 | byte)
                if child is None:
                    child = self.children[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = child
            self.token[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.logs: dict[int, tuple[list[int], list[bytes], list[bytes]] | None] = {}
        self._forget()

    def _forget(self) -> None:
        self.start = State(self, ((0, -1, ()),))
        self.states = {self.start.positions: self.start}

    def merged(self, raw: bytes) -> tuple[list[int], list[bytes], list[bytes], bool]:
        """The merges of a token's bytes alone, the least rank first and the leftmost of equal ones: the rank
        of each merge, the first part and the last part before each and at the end, and whether one part is left."""
        parts, rank = [raw[i : i + 1] for i in range(len(raw))], self.ranks.get
        done, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            least, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            done.append(least)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        return done, firsts, lasts, len(parts) == 1

    def _log(self, token: int) -> tuple[list[int], list[bytes], list[bytes]] | None:
        """What ``merged`` says of a token; None if its own bytes don't become it."""
        if token not in self.logs:
            *log, whole = self.merged(self.raw[token])
            self.logs[token] = tuple(log) if whole else None
        return self.logs[token]

    def follows(self, before: int, token: int) -> bool:
        """Whether the merges leave the two tokens side by side as they are (before is -1 at the start).

        Until some merge joins the two, each side is merged as if alone, in the order of the next ranks.
        So the two logs are played together, and the parts at the border are looked up at each state.
        """
        known = self.pairs.get((before, token))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[before, token] = self._follows(before, token)
        return known

    def _follows(self, before: int, token: int) -> bool:
        right = self._log(token)
        if before < 0 or right is None:
            return right is not None
        left = self._log(before)
        if left is None:
            return False
        (left_ranks, _, lasts), (right_ranks, firsts, _) = left, right
        i = j = 0
        while True:
            a = left_ranks[i] if i < len(left_ranks) else None
            b = right_ranks[j] if j < len(right_ranks) else None
            across = self.ranks.get(lasts[i] + firsts[j])
            # Of equal ranks the leftmost goes first: the left side, the border, the right side.
            if across is not None and (a is None or across < a) and (b is None or across <= b):
                return False
            if a is None and b is None:
                return True
            if b is None or a is not None and a <= b:
                i += 1
            else:
                j += 1

    def step(self, positions: tuple[tuple[int, int, tuple[int, ...]], ...], byte: int) -> tuple[tuple[int, ...], State]:
        """What a byte makes certain, and the state of the positions after it, the one at the root last."""
        found, root = [], None
        for node, before, waiting in positions:
            child = self.children.get(node << 8 | byte)
            if child is None:
                continue
            # One sequence of tokens encodes the bytes so far, so one token at most ends here.
            if root is None and (token := self.token[child]) >= 0 and self.follows(before, token):
                root = (0, token, (*waiting, token))
            if self.inner[child]:
                found.append((child, before, waiting))
        if root is None:
            raise ValueError(f"byte {byte} is no token of the vocabulary")
        found.append(root)
        certain = min((p[2] for p in found), key=len)
        if certain:
            for _, _, waiting in found:
                while waiting[: len(certain)] != certain:
                    certain = certain[:-1]
            n = len(certain)
            found = [(node, before, waiting[n:]) for node, before, waiting in found] if n else found
        key = tuple(found)
        after = self.states.get(key)
        if after is None:
            if len(self.states) >= STATES:
                self._forget()
            after = self.states[key] = State(self, key)
        return certain, after

    def emitted(self, raw: Iterable[int]) -> Iterator[int]:
        """Token ids of a stretch of bytes, each as soon as it is certain."""
        state = self.start
        for byte in raw:
            certain, state = state[byte]
            if certain:
                yield from certain
        yield from state.last


class Utf8Machine:
    """Streaming decoder of tokens; bytes that are no UTF-8 become U+FFFD.

    A token of whole characters leads from no pending bytes back to none; only other steps are looked up.
    """

    def __init__(self, raw: dict[int, bytes]):
        self.raw, self.steps = raw, {}
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")
        self.whole: list[str | None] = [None] * (max(raw, default=-1) + 1)
        for token, own in raw.items():
            with contextlib.suppress(UnicodeDecodeError):
                self.whole[token] = own.decode()

    def _step(self, pending: bytes, token: int) -> tuple[str, bytes]:
        self.decoder.setstate((pending, 0))
        found = self.decoder.decode(self.raw[token]), self.decoder.getstate()[0]
        if len(self.steps) >= PAIRS:
            self.steps.clear()
        self.steps[pending, token] = found
        return found

    def decoded(self, ids: Iterable[int]) -> Iterator[str]:
        """Finished text of each token, and what is left at the end."""
        pending, known, whole = b"", self.steps.get, self.whole
        for token in ids:
            text = None if pending else whole[token]
            if text is None:
                text, pending = known((pending, token)) or self._step(pending, token)
            yield text
        self.decoder.setstate((pending, 0))
        yield self.decoder.decode(b"", True)


class TransducerCodec:
    """Encodes whole texts as the pattern and the ranks say, and decodes ids."""

    def __init__(self, path: str, pattern: str, plain: str):
        import regex

        ranks = read_ranks(path)
        self.split_any = regex.compile(pattern).findall
        # The same pattern for texts of ASCII and the letters of Latin-1, about which all versions of Unicode agree.
        self.split_plain = re.compile(plain).findall
        self.machine, self.texts = Transducer(ranks), Utf8Machine({rank: token for token, rank in ranks.items()})
        self.known = Remembered(self._match)
        # The tables above live as long as the worker: the garbage collector needn't walk them again and again.
        gc.collect()
        gc.freeze()
        gc.set_threshold(50_000, 20, 100)

    def _match(self, match: str) -> bytes:
        raw = match.encode()
        whole = self.machine.ranks.get(raw)
        ids = array("I", self.machine.emitted(raw) if whole is None else [whole])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def split(self, text: str) -> list[str]:
        """The matches of the pattern, one after another."""
        return self.split_plain(text) if _PLAIN.fullmatch(text) else self.split_any(text)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.split(text))), "<u4")

    def decode(self, ids: list[int]) -> str:
        return "".join(self.texts.decoded(ids))


def _settings(path: str | None, pattern: str | None) -> tuple[str, str, str]:
    """Vocabulary file, pattern, and the pattern for plain texts. Patterns are spelled on the driver, once."""
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    return path or default_path(RANK_FILE), split_pattern(pattern), pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{LETTERS}0-9]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", "[0-9]")


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""
    settings = _settings(path, pattern)

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = codec(TransducerCodec, *settings)
        for keys, rows in pairs_of(batches, "doc_id", "text"):
            found = [own.encode(t) for t in rows]
            offsets = np.cumsum([0, *map(len, found)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists(offsets, np.concatenate(found).astype(np.int32))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of every row of ids; null ids count as none."""
    settings = _settings(path, None)

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = codec(TransducerCodec, *settings)
        for keys, rows in pairs_of(batches, "doc_id", "ids"):
            found = [own.decode(r or []) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    settings = _settings(path, pattern)

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = codec(TransducerCodec, *settings)
        decimal = [str(i).encode() for i in range(max(own.machine.raw) + 1)]
        for keys, rows in pairs_of(batches, "doc_id", "text"):
            counts, id_digests, text_digests = [], [], []
            for text in rows:
                ids = own.encode(text).tolist()
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest())
                text_digests.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
