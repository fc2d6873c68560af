"""Operators against brute-force versions on odd, repeated and empty rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recfuse.llm import bpe, ngram_join, orc_tokens, packing, quality_rules, secrets, suffix_dedup, syncmers
from recfuse.llm.components import components, extended
from recfuse.llm.common import stored

LABELS = "doc_id long, quality int, toxic int"


def text_of(row):
    return row["text"] or ""


def by_id(rows, cut):
    """Counter of (doc_id, value), as doc_ids may repeat."""
    return Counter((r["doc_id"], cut(r)) for r in rows)


def collected(df, *columns):
    return Counter((r["doc_id"], tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]]) for r in df.collect())


def ids_of(text, name, end=None):
    found = Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids
    return found + ([] if end is None else [end])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_bpe_round_trip(small, rows):
    got = collected(bpe.round_trip_digests(small), "n_tokens", "ids_sha256", "decoded_sha256")

    def want(r):
        ids = ids_of(text_of(r), "byte_bpe_50k.json")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text_of(r).encode()).hexdigest()

    assert got == by_id(rows, want)
    again = collected(bpe.decode(bpe.encode(small)), "text")
    assert again == by_id(rows, text_of)


def test_orc_files(spark, small, rows, tmp_path):
    path = f"file://{tmp_path}/ids"
    got = sorted(orc_tokens.written_digests(small, path).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(
        (r["doc_id"], len(ids_of(text_of(r), "word_bpe_49k.json", 2)), crc(ids_of(text_of(r), "word_bpe_49k.json", 2))) for r in rows
    )
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert orc_tokens.read(spark, path).where("doc_id = 3").count() == 1


def test_packing(small, rows):
    got = packing.pack(small).collect()
    sequences, docs = defaultdict(list), defaultdict(int)
    for r in got:
        sequences[r["sequence_id"]].append(r)
        docs[r["doc_id"]] += r["length"]
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert sum(r["length"] for r in own) <= packing.SEQUENCE
    want = defaultdict(int)
    for r in rows:
        ids = ids_of(text_of(r), "word_bpe_49k.json", 1)
        want[r["doc_id"]] += len(ids)
        assert any(p["doc_id"] == r["doc_id"] and p["ids_crc32"] == crc(ids[p["start"] : p["start"] + p["length"]]) for p in got)
    assert docs == want


def test_packing_plan_places_every_piece_with_little_padding():
    rng = np.random.default_rng(1)
    histogram = dict(zip(*np.unique(rng.integers(1, 65, 20_000), return_counts=True), strict=True))
    made = packing.plan({int(u): int(n) for u, n in histogram.items()}, 64)
    placed = Counter()
    for column, times in made:
        assert sum(u * n for u, n in column.items()) <= 64
        for u, n in column.items():
            placed[u] += n * times
    assert placed == histogram
    assert sum(u * n for u, n in histogram.items()) >= 0.99 * 64 * sum(t for _, t in made)


def test_quality_rules(small, rows):
    def want(r):
        t = text_of(r)
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))

    judged = quality_rules.judged(small)
    assert collected(judged, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == by_id(rows, want)
    kept = quality_rules.keep(small)
    assert kept.columns == small.columns
    assert kept.count() == judged.where("kept").count()


def test_secrets(spark):
    key = "q9Zx7Lm2Vb8Rt4Wp6Ks1"
    texts = [
        f"token: {key} and", f"see {key}.", "a" * 40, "PASSWORD='abcdefgh'", "secret=token: abcdefghij", "AKIA" + "A1" * 6, None, "",
        "550e8400-e29b-41d4-a716-446655440000", "0123456789abcdef" * 4,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert got[0]["spans"] == f"assign:0:{7 + len(key)}" and got[1]["spans"] == f"random:4:{4 + len(key)}"
    assert [got[i]["spans"] for i in (2, 3, 4, 5)] == ["hex:0:40", "assign:0:18", "", "access:0:16"]
    assert [got[i]["spans"] for i in (6, 7, 8)] == ["", "", ""] and got[9]["n_hex"] == 1
    assert got[2]["base_sha256"] == hashlib.sha256(b"hex:0:40").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[1] == "see [SECRET]." and clean[6] is None and clean[8] == texts[8]


def test_secrets_of_letters_and_behind_paths():
    scanner, rng = secrets.Scanner(bpe.default_path("byte_bpe_50k.tiktoken"), secrets.CHARS_PER_TOKEN), np.random.default_rng(5)
    lower, letters = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    key = lambda of, n: "".join(rng.choice(list(of), n))

    def share(before, of, n, after=""):
        """How many of 300 keys are found whole: a span may hold more than the key."""
        keys = [key(of, n) for _ in range(300)]
        found = [scanner.added(f"see {before}{k}{after} now", []) for k in keys]
        at = 4 + len(before)
        return np.mean([any(a <= at and at + n <= b for a, _, b in f) for f in found])

    assert share("", lower, 24) > 0.7 and share("", letters, 20) > 0.95
    alone = share("", letters + "0123456789", 24)
    for before, after in (("com/services/integration/", ""), ("environment=", "/settings"), ("customer-integration_production_", ""), ("com/services/integration/configuration_of_", "")):
        assert share(before, letters + "0123456789", 24, after) > alone - 0.05
    prose = [
        "internationalization", "com/services/integration/configuration", "Krankenversicherungsbeitrag", "get_elements_by_class_name", "NullPointerException", "2024/11/05/1234567890123456",
        "aaaaaaaaaaaaaaaaaaaaaaaa", "------------------------",
    ]
    assert [scanner.added(t, []) for t in prose] == [[]] * len(prose)
    text = "password=abcdefgh1234 and x"
    assert scanner.added(text, scanner.base(text)) == []


def test_filter_on_the_verdict(spark):
    """A filter after the rules evaluates nothing again."""
    df = spark.createDataFrame([(1, "word " * 4000), (2, "the " + "of lines and words " * 3)], "doc_id long, text string")
    assert [r["doc_id"] for r in quality_rules.judged(df).where("not kept").collect()] == [1, 2]
    assert quality_rules.judged(df).where("kept and n_words > 5").count() == 0


def brute_classes(rows):
    sets = []
    for r in rows:
        words = text_of(r).encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        key = find(i)
        least[key] = min(least.get(key, 10**9), 10**9 if r["doc_id"] is None else r["doc_id"])
    return Counter((r["doc_id"], (len(sets[i]), None if least[find(i)] == 10**9 else least[find(i)])) for i, r in enumerate(rows))


def test_ngram_join(small, rows):
    assert collected(ngram_join.classes(small), "n_shingles", "component_id") == brute_classes(rows)
    kept = ngram_join.keep_first(small)
    assert kept.columns == small.columns


def test_keep_first_over_null_shared_and_repeated_ids(spark):
    """One row of each brute-force component stays, that with the least id; null ids and texts that share an id are told apart."""
    line = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    texts = [
        (None, line("a")), (None, line("b")), (None, line("c")), (None, line("c") + " more"),  # nulls: a, b alone; c twice
        (None, line("d")), (4, line("d") + " more"), (9, line("d")),  # a null id beside real ones
        (5, line("e")), (5, line("f")), (5, line("g")), (3, line("g") + " more"),  # one id, three texts; g belongs to 3
        (6, line("h")), (6, line("h")), (6, line("h") + " more"),  # repeated and near rows of one id
        (7, ""), (7, None), (None, " \n\t"), (None, None), (8, "\x0b\x0c\r"), (7, ""),  # no words
        (None, "\u00a0"), (None, "\u00a0"), (-(2**62), "one two"), (None, "one two"),
    ]
    rows = [{"doc_id": i, "text": t, "part": k} for k, (i, t) in enumerate(texts)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, part int").repartition(3)
    assert collected(ngram_join.classes(df), "n_shingles", "component_id") == brute_classes(rows)
    # Each row's component by brute force: ids made unique, in the order of the ids, null ids last.
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, text_of(r)))
    component = {}
    for k, r in enumerate(order):
        words = text_of(r).encode().lower().split()
        five = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
        like = [component[j] for j in range(k) if five and 100 * len(five & order[j]["five"]) >= 80 * len(five | order[j]["five"])]
        r["five"], component[k] = five, min(like, default=k)
    groups = defaultdict(list)
    for k, r in enumerate(order):
        groups[component[k]].append(r)
    for got in (ngram_join.keep_first(df).collect(), corpus_pipeline.one_of_each(spark, df, "").collect()):
        kept = {r["part"] for r in got}
        assert len(got) == len(kept)
        for own in groups.values():
            parts = {r["part"] for r in own if r["doc_id"] == own[0]["doc_id"]}
            left = {r["part"] for r in own} & kept
            assert left == {own[0]["part"]} if not own[0]["five"] else len(left) == 1 and left <= parts


def test_ngram_join_over_several_pages(spark, monkeypatch):
    """A large group around the limit, in pages of few nodes: some copies are linked to few others or none."""
    monkeypatch.setattr(ngram_join, "PAGE", 3000)
    rng = np.random.default_rng(7)
    base, texts = [f"w{k}" for k in range(120)], []
    for k in range(120):
        words = list(base)
        for at in rng.choice(120, rng.integers(1, 6), replace=False):
            words[at] = f"x{k}-{at}"
        texts.append(" ".join(words))
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(texts)]
    got = ngram_join.classes(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string"))
    assert collected(got, "n_shingles", "component_id") == brute_classes(rows)
    assert len({c for _, (_, c) in brute_classes(rows)}) > 2


@pytest.mark.parametrize("group", [1, 8])
def test_ngram_join_over_large_groups(spark, small, rows, monkeypatch, group):
    """Groups that are not listed go through chains and pages, frequent shingles or not."""
    monkeypatch.setattr(ngram_join, "GROUP", group)
    assert collected(ngram_join.classes(small), "n_shingles", "component_id") == brute_classes(rows)


def test_shared_passages_make_no_chain_of_unlike_texts(spark, monkeypatch):
    """Texts that each share a passage with the next one were one chain, whose pages all met: work with the square of the texts."""
    placed = []
    forests = ngram_join._forests
    monkeypatch.setattr(ngram_join, "_forests", lambda state, *more: placed.append(state.count()) or forests(state, *more))
    line = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = [{"doc_id": i, "text": f"{line(f'p{i}x', 30)} {line(f'q{i}x', 20)} {line(f'p{i + 1}x', 30)}"} for i in range(60)]
    rows.append({"doc_id": 99, "text": rows[7]["text"] + " more"})
    got = ngram_join.classes(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string"))
    assert collected(got, "n_shingles", "component_id") == brute_classes(rows)
    assert sum(placed) == 0


def test_prefix_takes_the_least_met_first():
    """Of the frequent shingles the rarer ones come first; a fixed order of hashes took any of them before."""
    found = np.arange(2, 202, 2).astype(np.uint64)
    frequent = ngram_join.Frequent(found[:95], np.r_[np.full(80, 9), np.full(15, 4)].astype(np.uint8))
    assert ngram_join.prefix(found, frequent).tolist() == [*found[95:].tolist(), *(found[80:95] | np.uint64(1)).tolist(), int(found[0]) | 1]
    assert ngram_join.prefix(found[:0], frequent).tolist() == []


def test_forest_joins_what_surviving_pairs_join():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 60, 90).astype(np.uint64)) for _ in range(12)]
    sets += [np.unique(np.concatenate([x[k:], rng.integers(0, 1 << 60, k).astype(np.uint64)])) for k in (3, 9, 30) for x in sets[:12]]
    page = ngram_join.Page([{"node": i, "root": i, "n": len(x), "items": x.tobytes()} for i, x in enumerate(sets)])
    label = list(range(len(sets)))
    for a, b in ngram_join.forest(page, page):
        assert label[a] != label[b] and ngram_join.similar(sets[a], sets[b])
        label = [label[a] if x == label[b] else x for x in label]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if ngram_join.similar(sets[i], sets[j])]
    assert len(pairs) > 12 and all(label[i] == label[j] for i, j in pairs)


def test_tree_finds_every_possible_pair():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 4, (70, 64))
    points[35:] = np.maximum(points[:35] - (rng.random((35, 64)) < 0.05), 0)
    n = points.sum(axis=1)
    found = set(ngram_join.survivors(points, n, np.arange(70), points, n, np.arange(70)))
    bound = lambda i, j: int(np.minimum(points[i], points[j]).sum())
    assert found == {(i, j) for i in range(70) for j in range(70) if i != j and ngram_join.may_link(n[i], n[j], bound(i, j))}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50 + k) for k in range(5)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {n: 50 for n in (50, 51, 52, 53, 54, 100)}


def test_extended_components(spark):
    rng = np.random.default_rng(1)
    edges = lambda n: [(int(a), int(b)) for a, b in rng.integers(0, 300, (n, 2))]
    first, more = edges(90), edges(60)
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    rows_of = lambda df: {r["node"]: r["root"] for r in df.collect()}
    known = stored(components(frame(first)), "test")
    got, want = rows_of(extended(known, frame(more))), rows_of(components(frame(first + more)))
    assert got == want and rows_of(extended(known, frame([]))) == rows_of(known)


def repeated_bytes(rows, length):
    """Row and a mask of the bytes that repeated strings cover."""
    raws = [text_of(r).encode() for r in rows]
    seen = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    for r, raw in zip(rows, raws, strict=True):
        gone = np.zeros(len(raw) + length, bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        yield r, raw, gone[: len(raw)]


def brute_repeats(rows, length=400):
    out = Counter()
    for r, raw, gone in repeated_bytes(rows, length):
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[(r["doc_id"], (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))] += 1
    return out


def test_suffix_dedup(small, rows):
    assert collected(suffix_dedup.digests(small), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)
    left = suffix_dedup.remove(small)
    assert left.columns == small.columns and left.count() == len(rows)


def without_passages(rows, length, words):
    """Texts without runs of repeated bytes that hold enough words."""
    out = Counter()
    for r, raw, gone in repeated_bytes(rows, length):
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0)).tolist()
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if len(raw[a:b].split()) < words:
                gone[a:b] = False
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        out[r["doc_id"], None if r["text"] is None else left] += 1
    return out


def test_suffix_dedup_by_words(small, rows):
    cut = suffix_dedup.Cut(200, 128)
    assert collected(suffix_dedup.digests(small, cut), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 200)
    for words in (0, 50, 150):
        assert collected(suffix_dedup.remove(small, cut, words), "text") == without_passages(rows, 200, words)


def test_suffix_digests_count_passages(spark, small, rows):
    """Passages of 50 words or more are counted, also below 400 bytes; what the 400-byte rule removes stays the same."""

    def want(rows, words):
        out = Counter()
        for r, raw, gone in repeated_bytes(rows, 200):
            edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0)).tolist()
            sizes = [b - a for a, b in zip(edges[::2], edges[1::2], strict=True) if len(raw[a:b].split()) >= words]
            out[r["doc_id"], (len(sizes), sum(sizes))] += 1
        return out

    rnd = np.random.default_rng(9)
    line = lambda n: " ".join("".join(chr(c) for c in rnd.integers(97, 123, 5)) for _ in range(n))
    planted, few = line(60), line(40)  # 359 and 239 bytes
    texts = [f"{line(70)}\n{planted}\n{line(70)}" for _ in range(4)] + [f"{line(90)}\n{few}\n{line(9)}" for _ in range(3)] + [line(150) for _ in range(4)]
    texts += [f"{line(8)} {planted}", f"{planted} {line(20)} {planted}", line(90), None]
    own = [{"doc_id": i, "text": t} for i, t in enumerate(texts)]
    got = suffix_dedup.digests(spark.createDataFrame([tuple(r.values()) for r in own], "doc_id long, text string")).cache()
    assert collected(got, "n_passages", "n_passage_bytes") == want(own, 50)
    assert {r["doc_id"] for r in got.collect() if r["n_passage_bytes"]} == {0, 1, 2, 3, 11, 12}
    assert collected(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(own) and not any(r["n_removed"] for r in got.collect())
    assert collected(suffix_dedup.digests(small), "n_passages", "n_passage_bytes") == want(rows, 50)
    other = suffix_dedup.digests(small, suffix_dedup.Cut(100, 64), suffix_dedup.Cut(200, 128), 30)
    assert collected(other, "n_passages", "n_passage_bytes") == want(rows, 30)
    assert collected(other, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 100)


def test_suffix_dedup_of_nuls(spark):
    """Runs of NULs hash to the least value there is; they are bytes like others."""
    rnd = np.random.default_rng(4)
    line = lambda n: "".join(chr(c) for c in rnd.integers(97, 123, n))
    shared = line(120) + "\0" * 16 + line(264)
    texts = ["\0" * 450, "\0" * 450, line(30) + shared + line(50), line(70) + shared + line(20), line(500), "\0" * 399]
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(texts)]
    got = suffix_dedup.digests(spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string"))
    want = brute_repeats(rows)
    assert collected(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == want and sum(w[1][1] for w in want) == 2 * 450 + 2 * 400


def test_merge_of_runs():
    rng = np.random.default_rng(3)
    runs = []
    for n in (0, 5, 1, 40, 17):
        own = sorted(bytes(rng.integers(97, 99, rng.integers(1, 12), np.uint8)) for _ in range(n))
        runs.append((own, [0, *(suffix_dedup.shared(a, b) for a, b in zip(own, own[1:], strict=False))][: len(own)]))
    order = list(suffix_dedup.merge_runs(runs))
    merged = [runs[r][0][i] for r, i, _ in order]
    assert merged == sorted(s for own, _ in runs for s in own)
    assert [n for _, _, n in order[1:]] == [suffix_dedup.shared(a, b) for a, b in zip(merged, merged[1:], strict=False)]


def test_syncmers(small, rows):
    got = syncmers.compared(small).collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    texts = [text_of(r) for r in order]
    want = Counter()
    for i, t in enumerate(texts):
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[(i + 1) % len(texts)][:half]
        want[(order[i]["doc_id"], (len(t), hashlib.sha256(edited.encode()).hexdigest()))] += 1
    assert Counter((r["doc_id"], (r["n_chars"], r["edited_sha256"])) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = defaultdict(set)
    for r in got:
        prints[next(text_of(x) for x in rows if x["doc_id"] == r["doc_id"])].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_syncmers_of_short_texts(spark):
    """Texts around 2K-S-1 words: unlike ones have unlike fingerprints and likeness 0, near ones are near, also across that length."""
    rows = []
    for n in range(1, 24):
        for k in range(20):
            words = [f"w{n}-{k}-{i}" for i in range(n)]
            rows.append((n, k, " ".join(words), " ".join([*words, "more"]), " ".join([*words[: n // 2], "other", *words[n // 2 + 1 :]]), " ".join(f"{w}x" for w in words)))
    df = spark.createDataFrame(rows, "n int, k int, own string, longer string, changed string, unlike string")
    for c in ("own", "longer", "changed", "unlike"):
        df = syncmers._anchors(df, c, f"_{c}")
    df = df.withColumn("fingerprint", syncmers.fingerprint("_own")).withColumn("fingerprint_unlike", syncmers.fingerprint("_unlike"))
    for a, b in (("own", "own"), ("own", "longer"), ("longer", "own"), ("own", "changed"), ("own", "unlike")):
        df = syncmers.likeness(df, f"_{a}", f"_{b}", f"{a}_{b}")
    got = df.collect()
    prints = {r["fingerprint"] for r in got} | {r["fingerprint_unlike"] for r in got}
    assert "" not in prints and len(prints) == 2 * len(got)
    assert all(r["own_own"] == 1 and r["own_unlike"] == 0 and r["own_longer"] == r["longer_own"] for r in got)
    for r in got:
        n = r["n"]
        if 3 <= n < syncmers.SURE:
            assert abs(r["own_longer"] - (n - 2) / (n - 1)) < 1e-9
        if 12 <= n < syncmers.SURE:
            assert abs(r["own_changed"] - (n - 5) / (n + 1)) < 1e-9


@pytest.mark.parametrize(
    "run",
    [bpe.round_trip_digests, orc_tokens.written_digests, packing.pack, quality_rules.judged, secrets.scan, ngram_join.classes, suffix_dedup.digests, syncmers.compared],
)
def test_empty_table(small, run):
    assert run(small.where(F.lit(False))).count() == 0
