"""Secret scan: patterns with a fixed shape, and random strings found by their token efficiency.

A random string splits into many short tokens of a vocabulary that was made for prose: its
characters per token are few. Candidates are runs of key-like characters with letters, and where a run
is not random as a whole, its parts between '/' and '=', and then between '_', '-' and '+' too. Strings
without digits have to stay below a stricter limit. Digests of usual lengths, UUIDs, numbers and strings
with dictionary-like efficiency are left out.

Null and empty texts have no spans. Repeated rows are scanned each on their own. Columns other than
doc_id and text are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recfuse.llm.bpe import codec, default_path
from recfuse.llm.common import pairs_of, texts

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Greedy runs of one class: asking for the least length finds the same spans as dropping short runs.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PARTS = (re.compile(r"[^/=]+"), re.compile(r"[^_+-]+"))
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
#: Fewer characters per token than this mark a random string.
CHARS_PER_TOKEN = 2.0
#: The share of that limit that holds for strings without digits, which long invented words resemble.
LETTERS_ONLY = 0.9
LEAST_RANDOM = 16


class Scanner:
    def __init__(self, vocabulary: str, chars_per_token: float):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.limit = chars_per_token

    def random(self, s: str) -> bool:
        if not re.search("[A-Za-z]", s) or _UUID.fullmatch(s):
            return False
        if len(s) in DIGEST_LENGTHS and _DIGEST.fullmatch(s):
            return False
        limit = self.limit if re.search("[0-9]", s) else self.limit * LETTERS_ONLY
        return len(s) < limit * len(self.encoding.encode_ordinary(s))

    def strings(self, s: str, at: int, base: list[tuple[int, int, int]], parts: tuple = _PARTS) -> Iterator[tuple[int, int, int]]:
        """The run s if it is random and no base span touches it, or else such parts of it."""
        end = at + len(s)
        if len(s) < LEAST_RANDOM:
            return
        if self.random(s) and not any(a < end and at < b for a, _, b in base):
            yield at, 3, end
            return
        for k, part in enumerate(parts):
            found = list(part.finditer(s))
            if any(len(m[0]) < len(s) for m in found):
                for m in found:
                    yield from self.strings(m[0], at + m.start(), base, parts[k + 1 :])
                return

    def base(self, text: str) -> list[tuple[int, int, int]]:
        low, found = text.lower(), []
        if "passw" in low or "secret" in low or "token" in low or "key" in low:
            found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return sorted(found)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Random strings that no base span touches."""
        return [s for m in _CANDIDATE.finditer(text) for s in self.strings(m[0], m.start(), base)]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, vocabulary: str | None = None, chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every whole text."""
    vocabulary = vocabulary or default_path("byte_bpe_50k.tiktoken")

    def run(batches) -> Iterator[pa.RecordBatch]:
        scanner = codec(Scanner, vocabulary, chars_per_token)
        for keys, rows in pairs_of(batches, "doc_id", "text"):
            out: list[tuple] = []
            for key, text in zip(keys, rows, strict=True):
                base = scanner.base(text)
                added = scanner.added(text, base)
                counts = [sum(s[1] == k for s in base) for k in range(3)]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                out.append((key, *counts, digest, _joined(sorted(base + added)), len(added)))
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return texts(docs).mapInArrow(run, kinds)


def redact(docs: DataFrame, vocabulary: str | None = None, chars_per_token: float = CHARS_PER_TOKEN, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span replaced by a mark; n_chars, if present, follows. Row-wise, no join."""
    vocabulary = vocabulary or default_path("byte_bpe_50k.tiktoken")

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        scanner = codec(Scanner, vocabulary, chars_per_token)

        def one(text):
            if not text:
                return text
            base = scanner.base(text)
            out, at = [], 0
            for a, _, b in sorted(base + scanner.added(text, base)):
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return column.map(one)

    texts(docs.select("doc_id", "text"))  # sets the batch size
    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
