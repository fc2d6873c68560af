import random

import pytest

from recfuse.llm.common import texts  # noqa: F401  the subpackage must be importable here

ODD = ["", None, " \n\t", "x", "one two", "é́ ß <|endoftext|> don't  \n\n 12a3", "a" * 3000, "word " * 4000]


@pytest.fixture(scope="session")
def small(spark):
    """Odd texts, repeated rows, near copies, shared passages, a null id, and columns with clashing names."""
    rnd = random.Random(7)
    syllables = ["the", "on", "ti", "er", "an", "ou", "lo", "we"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = line(120)
    rows = list(ODD) + [line(rnd.randint(5, 200)) for _ in range(20)]
    rows += [f"{line(30)}\n{passage}\n{line(30)}" for _ in range(6)]
    base = line(150).split()
    for k in range(8):
        copy = list(base)
        copy[10 * k] = "other"
        rows.append(" ".join(copy))
    rows += [rows[12], rows[12]]
    out = [(i, t, "en", f"src{i % 3}", None if t is None else len(t), "k", i) for i, t in enumerate(rows)]
    out += [out[15], (None, "no id at all here", None, None, 3, "k", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, h string, part int"
    return spark.createDataFrame(out, schema).repartition(3)


@pytest.fixture(scope="session")
def rows(small):
    return [r.asDict() for r in small.collect()]
