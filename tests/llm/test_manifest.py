"""The Merkle manifest against a brute-force version."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from recfuse.llm import manifest, queries
from tests.oracle import connect, rows_of

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, total int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
        return out

    def siblings(levels, slot):
        for nodes in levels[:-1]:
            first = slot // 3 * 3
            yield nodes[first:slot], nodes[slot + 1 : first + 3]
            slot //= 3

    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    for own in groups.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r, r["text"]) for r in groups[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = Counter()
    for place, source in enumerate(order):
        for slot, r in enumerate(groups[source]):
            way, text = [*siblings(trees[source], slot), *siblings(top, place)], r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for left, right in way:
                node = digest("".join(left) + node + "".join(right))
            proof = digest("".join("".join(left) + "".join(right) for left, right in way))
            out[r["doc_id"], leaf(r, r["text"]), trees[source][-1][0], top[-1][0], proof, node, node == top[-1][0]] += 1
    return out


def check(df, *depth):
    rows = [r.asDict() for r in df.collect()]
    found = Counter(map(tuple, manifest.manifest(df, *depth).collect()))
    assert found == brute(rows)
    return found


def test_small(small):
    found = check(small)
    assert not all(key[6] for key in found) and any(key[6] for key in found)
    assert manifest.manifest(small.where(F.lit(False))).count() == 0
    check(small.where("doc_id = 9"))


def test_against_sql(spark):
    df = queries.QUERIES["op13_rank_manifest"](spark, SF_DIR)
    cursor = connect(SF_DIR).execute(queries.SQL["op13_rank_manifest"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_repeated_and_null_ids(spark):
    """Ids that repeat, also with equal rows, null ids and sources, ids far apart and negative, null fields."""
    rnd = random.Random(5)
    ids = [None, 5, -3, 2**62, -(2**63), 2**63 - 1, *range(60)]
    texts, sources = ["", "a\n", "b\n\n c", None, "é"], [None, "", "a", "b", "é", "Z", "s1", "s2"]
    rows = [
        (rnd.choice(ids) if rnd.random() < 0.6 else rnd.randrange(-(10**6), 10**6), rnd.choice(texts), rnd.choice(["en", None]), rnd.choice(sources), rnd.choice([1, None]), "k", 0)
        for _ in range(4000)
    ]
    check(spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_several_rounds_of_arrays(spark):
    """Arrays of nine slots: several rounds within a source and over the sources."""
    rows = [(k, f"t\n{k}", "en", "hot" if k % 3 else f"s{k % 400}", 3, "k", 0) for k in range(900)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(4), 2)


def test_ranks_of_a_bitmap(spark):
    rnd = random.Random(2)
    ids = rnd.sample(range(-(10**7), 10**7), 3000) + list(range(100, 900))
    df = spark.createDataFrame([(i, "", "en", f"s{i % 3}", 1, "k", 0) for i in dict.fromkeys(ids)], SCHEMA)
    got = {r["doc_id"]: (r["rank"], r["total"]) for r in manifest.ranked(manifest.stored(manifest.leaves(df), "test")).collect()}
    for s in range(3):
        own = sorted(i for i in got if i % 3 == s)
        assert [got[i] for i in own] == [(k, len(own)) for k in range(len(own))]
