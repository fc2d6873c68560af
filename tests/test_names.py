"""Similar-name groups against the plain greedy scan."""

import random
import re

import pytest

from recfuse.operators import names as NM
from recfuse.operators.rank import spread_row_number
from pyspark.sql import functions as F


def normal(name):
    s = re.sub(r"^(spacex\s+|mission\s+)", "", name.lower())
    s = re.sub(r"\s+(mission|launch)$", "", s)
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s)).strip()


def similar(a, b):
    if not a or not b:
        return False
    x, y = normal(a), normal(b)
    if x == y or x in y or y in x:
        return True
    p, q = set(x.split()), set(y.split())
    return bool(p and q) and len(p & q) / max(len(p), len(q)) >= 0.7


def greedy(names):
    groups, done = {}, set()
    for i, n in enumerate(names):
        if i in done:
            continue
        done.add(i)
        for j in range(i + 1, len(names)):
            if j not in done and similar(n, names[j]):
                groups.setdefault(i, {i}).add(j)
                done.add(j)
    return groups


def grouped(spark, names, **kw):
    df = spark.createDataFrame(list(enumerate(names)), "seq long, name string")
    out = {}
    for r in NM.similar_name_rows(df, "name", "seq", **kw).collect():
        out.setdefault(r.leader, set()).add(r.seq)
        assert r.group_size >= 2
    return out


def words(n, seed):
    rng = random.Random(seed)
    vocabulary = ["falcon", "crew", "relay", "demo", "heavy", "a", "ab", "orbit", "x1", "x12", "mission", "launch", "!!"]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 7))) for _ in range(n)]


@pytest.mark.parametrize("budget", [5_000_000, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_greedy(spark, seed, budget, monkeypatch):
    if budget == 0:
        # Force the rounds that never list pairs.
        monkeypatch.setattr(NM, "PAIRS_PER_BLOCK_ROW", 0)
    names = [*words(120, seed), None, "", "..."]
    assert grouped(spark, names, min_pair_budget=budget) == greedy(names)


@pytest.mark.parametrize("a,b,same", [("Falcon Heavy Demo", "Falcon Heavy Demo Mission", True), ("Crew-8", "Relay 6-1", False),
                                      ("SpaceX Crew Dragon", "Crew Dragon", True), ("Falcon 9 Launch", "Falcon Heavy Launch", False)])
def test_pairs(spark, a, b, same):
    assert bool(grouped(spark, [a, b])) is same


def test_copies_share_a_group(spark):
    names = ["Relay one two three"] * 50 + ["Other thing here"]
    assert grouped(spark, names) == {0: set(range(50))}


def test_spread_row_number(spark):
    rows = [(random.Random(i).choice("ab"), i % 3, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, p int, seq long")
    got = {(r.k, r.seq): r.rn for r in spread_row_number(df, ["k"], [F.col("p")], ["seq"], "rn", chunk=16).collect()}
    for key in "ab":
        for n, (_, _, seq) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            assert got[key, seq] == n


@pytest.mark.parametrize("looked_at", [0, 2000])
def test_letters_and_inner_runs(spark, looked_at, monkeypatch):
    """Contained names of any number of words, cut inside words at both ends, and empty ones; equal to the greedy scan."""
    monkeypatch.setattr(NM, "PAIRS_PER_BLOCK_ROW", 0)
    monkeypatch.setattr(NM, "LOOKED_AT_PER_BLOCK_ROW", looked_at)
    rng = random.Random(5)
    long = [" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    parts = [n[i : i + rng.randrange(1, 25)] for n in long for i in [rng.randrange(len(n))]]
    names = [*parts, *long, "é", "", "!!"]
    rng.shuffle(names)
    assert grouped(spark, names, min_pair_budget=0) == greedy(names)


def test_blocks_stay_near_the_names(spark):
    """Long names that share no run of words keep no row to be looked up in; each had one for every letter before."""
    rng = random.Random(3)
    names = [" ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(40)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(names)), "seq long, name string")
    NM.ensure_checkpoint_dir(spark)
    needles, hay = NM.containment_blocks(NM.distinct_names(df, "name", "seq"))
    assert needles.isEmpty() and hay.isEmpty()


def test_unlike_names_of_a_block_are_not_listed(spark):
    """A rare word in common is no candidate when the other words tell the names apart; all of a block were before."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(300)]
    df = spark.createDataFrame([(i, " ".join(rng.sample(vocabulary, 20))) for i in range(50)], "seq long, name string")
    NM.ensure_checkpoint_dir(spark)
    blocks = NM._Blocks.of(NM.distinct_names(df, "name", "seq"), 0.7)
    assert blocks.pair_count()[0] > 50
    assert blocks.meet(blocks).isEmpty()


def test_no_function_of_arrays_per_word(spark):
    """Runs, seams and letters are hashed in compiled rows; each word of a name called functions of its array before."""
    names = NM.distinct_names(spark.createDataFrame([(1, "one two three four"), (2, "a"), (3, "two three")], "seq long, name string"), "name", "seq")
    wanted = spark.createDataFrame([(1,)], "block long")
    for kinds in ({"3"}, {"1", "2"}, {"1", "seam"}):
        plan = NM.hay_blocks(names.localCheckpoint(), wanted, kinds)._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and "Generate explode" in plan


def test_letters_are_looked_up_in_words(spark):
    """Names of one and two letters, of any alphabet, meet every name with a word that holds them."""
    names = ["o", "é", "ab", "b", "x y", "One two", "caféa abc", "xab cd", "zz yy", "ßb", ""]
    assert grouped(spark, names) == greedy(names)
