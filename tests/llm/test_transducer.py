"""The BPE transducer against the tiktoken library."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from recfuse.llm import transducer
from recfuse.llm.bpe import default_path
from tests.llm.test_operators import by_id, collected, text_of

RANKS = transducer.read_ranks(default_path(transducer.RANK_FILE))
LIBRARY = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return transducer.TransducerCodec(*transducer._settings(None, None))


def test_round_trip(small, rows):
    def want(r):
        ids = LIBRARY.encode_ordinary(text_of(r))
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text_of(r).encode()).hexdigest()

    assert collected(transducer.round_trip_digests(small), "n_tokens", "ids_sha256", "decoded_sha256") == by_id(rows, want)
    assert collected(transducer.decode(transducer.encode(small)), "text") == by_id(rows, text_of)
    assert transducer.round_trip_digests(small.where(F.lit(False))).count() == 0


def test_odd_texts(own):
    rnd, tokens = random.Random(3), list(RANKS)
    letters = [*"abcdefgh", " ", " ", "'", "\n", "0", "é", "Ж", "中", "😀", " ", " ", "\x1c", "́"]
    kinds = [
        lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))),
        lambda: b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 8))).decode("utf-8", "replace"),
        lambda: "".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(1, 60))),
        lambda: rnd.choice(["a", "ab", "aab", " ", "!", "=", "10", "\n "]) * rnd.randint(1, 90) + rnd.choice(["", "x", " y"]),
    ]
    for k in range(8000):
        text = kinds[k % len(kinds)]()
        ids = own.encode(text).tolist()
        assert ids == LIBRARY.encode_ordinary(text), text
        assert own.decode(ids) == text


def test_every_character(own):
    """Also characters that only some versions of Unicode know are split as by the library."""
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000, 7))]
    for k in range(0, len(every), 4000):
        text = "".join(f"a{c}1{c} {c}!{c}\n" for c in every[k : k + 4000])
        assert own.encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_few_states_are_enough(own, monkeypatch):
    """Forgetting states and pairs changes nothing."""
    monkeypatch.setattr(transducer, "STATES", 3)
    monkeypatch.setattr(transducer, "PAIRS", 5)
    machine = transducer.Transducer(RANKS)
    for text in ("internationalization", "aaaaaaaaaaaaaaaaaaaaaaaaa", "Donaudampfschifffahrt", "=" * 100):
        assert list(machine.emitted(text.encode())) == LIBRARY.encode_ordinary(text)


def test_lookahead_is_bounded():
    """After each byte, the tokens held back cover no more bytes than the longest token."""
    machine, longest = transducer.Transducer(RANKS), max(map(len, RANKS))
    text = ("abcdefghij" * 30 + "=" * 300 + "a" * 300).encode()
    state, emitted = machine.start, 0
    for n, byte in enumerate(text, 1):
        certain, state = state[byte]
        emitted += sum(len(machine.raw[t]) for t in certain)
        assert n - emitted <= longest


def test_other_ranks():
    """Small made-up vocabularies, where a token's parts may have any rank, against the library."""
    rnd = random.Random(9)
    for _ in range(60):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 256 + 25:
            a, b = rnd.choice(sorted(t for t in tokens if set(t) <= set(b"abc"))), rnd.choice(sorted(t for t in tokens if set(t) <= set(b"abc")))
            tokens.add(a + b)
        more = sorted(tokens - {bytes([b]) for b in range(256)})
        rnd.shuffle(more)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(more)}
        machine = transducer.Transducer(ranks)
        library = tiktoken.Encoding("made", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(40):
            text = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 20)))
            if text.encode() not in ranks:
                assert list(machine.emitted(text.encode())) == library.encode_ordinary(text)


def test_utf8_machine():
    raw = {0: b"a", 1: "é".encode()[:1], 2: "é".encode()[1:], 3: "😀".encode()[:2], 4: "😀".encode()[2:], 5: b"\xff", 6: "ü".encode()}
    machine, rnd = transducer.Utf8Machine(raw), random.Random(1)
    for _ in range(3000):
        ids = [rnd.randrange(7) for _ in range(rnd.randint(0, 9))]
        assert "".join(machine.decoded(ids)) == b"".join(raw[i] for i in ids).decode("utf-8", "replace")
    assert Counter(machine.decoded([1, 2])) == Counter(["", "é", ""])
