"""Removal of long repeated strings by a distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Sorting a
suffix at every byte would move some hundred times the corpus, so suffixes start at anchors chosen
by content alone: positions whose hash of ``gram`` bytes is least in some window of ``window``
starts. Every string of that length holds the anchor of its first window, at the same place
wherever the string occurs, so two occurrences meet as suffixes of their anchors. ``Cut`` has the
three numbers.

1. Anchors whose next length - window + 1 bytes occur once in the corpus are dropped (by a hash;
   a collision only keeps an anchor that the exact steps reject).
2. Each task sorts the suffixes of its anchors into runs, merges equal ones with equal left
   contexts, and sends each run front-coded: the length shared with the suffix before, and the rest.
3. Each receiving task merges its runs with a loser tree over (shared length, suffix). Lengths
   already known are never compared again, and the merge gives the shared length of all neighbours.
4. For each offset o of the string before the anchor, two suffixes hold the same string if their
   shared length is length - o at least and the o bytes before them are equal (by a 64-bit hash).

Longer strings hold these anchors too, so one sort serves several lengths: ``digests`` also counts passages,
repeated runs that are shorter than its ``cut`` but hold enough words (``PASSAGE``, ``PASSAGE_WORDS``).

Null text counts as empty; texts shorter than that length lose nothing. Repeated rows are places of their
own, so all bytes of a repeated text of that length or more go. Columns other than doc_id and text
are ignored by ``spans`` and kept by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recfuse.llm.common import dropped, pairs_of, stored, texts
from recfuse.sources.snapshots import shuffles_released


@dataclass(frozen=True)
class Cut:
    """length: of the strings that count; window: of starts with an anchor, a power of two; gram: bytes an anchor's hash reads (16).

    The window is shorter than the length by more than the gram.
    """

    length: int = 400
    window: int = 256
    gram: int = 16

    @property
    def stretch(self) -> int:
        return self.length - self.window + 1


CUT = Cut()
#: Passages are runs of repeated strings of this length that hold so many words.
PASSAGE = Cut(length=200, window=128)
PASSAGE_WORDS = 50
#: Suffixes in a run, and about as many as a receiving task merges.
RUN = 60_000
MERGED = 40_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_KEYS = ("_k1", "_k2")


def _keyed(docs: DataFrame) -> DataFrame:
    """A key for rows: the same for repeated rows, different for rows that share a doc_id only."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_k1", F.coalesce(F.col("doc_id"), F.lit(-(2**63)))).withColumn("_k2", F.xxhash64(text))


def _least(values: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """The least (or greatest) of each ``width`` (a power of two) neighbours."""
    step = 1
    while step < width:
        values = of(values[:-step], values[step:])
        step *= 2
    return values


def anchor_positions(raw: bytes, cut: Cut = CUT) -> np.ndarray:
    n = len(raw)
    if n < cut.length:
        return np.zeros(0, np.int64)
    count = n - cut.gram + 1
    a, b = (np.ndarray((count,), "<u8", raw, k, (1,)) for k in (0, 8))
    h = a * _A ^ (b * _B + (a >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * _C
    h ^= h >> np.uint64(31)
    least = _least(h, cut.window)[: n - cut.length + 1]
    # A position is an anchor if it is least in a window that holds it: the greatest of those minima.
    pad = np.zeros(cut.window - 1, np.uint64)
    greatest = _least(np.concatenate([pad, least, pad]), cut.window, np.maximum)
    # Each of the positions is in a window, whose minimum the zeros of the padding never exceed.
    return np.flatnonzero(h[: len(greatest)] == greatest)


def _anchors(docs: DataFrame, cut: Cut) -> DataFrame:
    from_names = "_k1 long, _k2 long, x int, h long"

    def run(batches) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for k1, k2, rows in pairs_of(batches, *_KEYS, "text"):
            places, hashes, counts = [], [], []
            for text in rows:
                raw = text.encode()
                at = anchor_positions(raw, cut)
                counts.append(len(at))
                places.append(at)
                hashes += [xxh3_64_intdigest(raw[x : x + cut.stretch]) for x in at.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(k1, np.int64), counts)),
                    pa.array(np.repeat(np.array(k2, np.int64), counts)),
                    pa.array(np.concatenate(places).astype(np.int32)),
                    pa.array(np.array(hashes, np.uint64).view(np.int64)),
                ],
                ["_k1", "_k2", "x", "h"],
            )

    return docs.select(*_KEYS, "text").mapInArrow(run, from_names)


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    top = min(len(a), len(b))
    if a[known:top] == b[known:top]:
        return top
    low, step = known, 16
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(low + step, top)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs with their neighbours' shared lengths: yields run, place in it, length shared with the one before."""
    size = 1
    while size < len(runs):
        size *= 2
    head = [s[0] if s else None for s, _ in runs] + [None] * (size - len(runs))
    place, known = [0] * size, [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser. The loser's known length becomes what it shares with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = shared(x, y, known[a])
        if x[n:] <= y[n:]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    losers = [0] * size
    level = list(range(size))
    while len(level) > 1:
        played = [play(level[i], level[i + 1]) for i in range(0, len(level), 2)]
        losers[len(played) : 2 * len(played)] = [b for _, b in played]
        level = [a for a, _ in played]
    first = level[0]
    while head[first] is not None:
        yield first, place[first], known[first]
        suffixes, lengths = runs[first]
        place[first] += 1
        if place[first] < len(suffixes):
            head[first], known[first] = suffixes[place[first]], lengths[place[first]]
        else:
            head[first] = None
        node = (first + size) // 2
        while node:
            first, losers[node] = play(first, losers[node])
            node //= 2


_RUN = "part int, sizes binary, lengths binary, rests binary, left_sizes binary, lefts binary, counts binary, k1 binary, k2 binary, x binary"


def _runs(rows: DataFrame, parts: int, cut: Cut, longest: int) -> DataFrame:
    """Sorted, front-coded runs of the suffixes (``longest`` bytes) at the places ``xs`` of each text, dealt by a hash of their first bytes."""

    def coded(found: list[tuple[bytes, bytes, int, int, int]]) -> Iterator[tuple]:
        from xxhash import xxh3_64_intdigest

        found.sort(key=lambda f: f[:2])
        by_part: dict[int, list[list]] = {}
        for right, left, k1, k2, x in found:
            part = xxh3_64_intdigest(right[: cut.stretch], seed=1) % parts
            own = by_part.setdefault(part, [])
            if own and own[-1][0] == right and own[-1][1] == left:
                own[-1][2].append((k1, k2, x))
            else:
                own.append([right, left, [(k1, k2, x)]])
        for part, own in by_part.items():
            known = [0, *(shared(a[0], b[0]) for a, b in zip(own, own[1:], strict=False))]
            members = np.array([m for o in own for m in o[2]], np.int64)
            yield (
                part,
                np.array([len(o[0]) for o in own], np.int32).tobytes(),
                np.array(known, np.int32).tobytes(),
                b"".join(o[0][n:] for o, n in zip(own, known, strict=True)),
                np.array([len(o[1]) for o in own], np.int32).tobytes(),
                b"".join(o[1] for o in own),
                np.array([len(o[2]) for o in own], np.int32).tobytes(),
                *(np.ascontiguousarray(members[:, c]).tobytes() for c in range(3)),
            )

    names = [c.split()[0] for c in _RUN.split(", ")]

    def batch_of(found) -> pa.RecordBatch:
        columns = list(zip(*coded(found), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for k1, k2, rows, places in pairs_of(batches, *_KEYS, "text", "xs"):
            for a, b, text, xs in zip(k1, k2, rows, places, strict=True):
                raw = text.encode()
                for x in xs:
                    found.append((raw[x : x + longest], raw[max(0, x - cut.window + 1) : x], a, b, x))
                if len(found) >= RUN:
                    yield batch_of(found)
                    found = []
        if found:
            yield batch_of(found)

    return rows.mapInArrow(run, _RUN)


def _decoded(row, cut: Cut) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray]:
    """Suffixes, shared lengths, and left contexts (reversed, in a matrix, with their sizes) of a run."""
    sizes, known = np.frombuffer(row.sizes, np.int32).tolist(), np.frombuffer(row.lengths, np.int32).tolist()
    suffixes, before, at = [], b"", 0
    for size, n in zip(sizes, known, strict=True):
        before = before[:n] + row.rests[at : at + size - n]
        at += size - n
        suffixes.append(before)
    left_sizes = np.frombuffer(row.left_sizes, np.int32)
    matrix = np.zeros((len(sizes), cut.window - 1), np.uint8)
    columns = np.arange(cut.window - 1)
    matrix[columns < left_sizes[:, None]] = np.frombuffer(b"".join(row.lefts[e - s : e][::-1] for s, e in zip(left_sizes, np.cumsum(left_sizes), strict=True)), np.uint8)
    return suffixes, known, matrix, left_sizes


def repeated_offsets(known: np.ndarray, sizes: np.ndarray, lefts: np.ndarray, left_sizes: np.ndarray, alone: np.ndarray, cut: Cut = CUT) -> np.ndarray:
    """For suffixes in order: a matrix that says for which offsets the string around the anchor occurs again."""
    n = len(sizes)
    out = np.zeros((n, cut.window), bool)
    before = np.full(n, 0x51ED270B, np.uint64)
    for o in range(cut.window):
        if o:
            before = (before + lefts[:, o - 1].astype(np.uint64) + np.uint64(1)) * _A
            before ^= before >> np.uint64(29)
        valid = np.flatnonzero((left_sizes >= o) & (sizes >= cut.length - o))
        group = np.cumsum(known < cut.length - o).astype(np.uint64)[valid]
        key = (before[valid] ^ (group * _B)) * _C
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        out[valid[order[1:][same]], o] = True
        out[valid[order[:-1][same]], o] = True
        out[valid[~alone[valid]], o] = True
    return out


def _merged(runs: DataFrame, cut: Cut, lengths: Sequence[int]) -> DataFrame:
    """Spans _k1, _k2, length, a, b (end exclusive) that repeated strings of each length cover."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        decoded = [(row, *_decoded(row, cut)) for row in group.itertuples(index=False)]
        order = list(merge_runs([(d[1], d[2]) for d in decoded]))
        bases = np.cumsum([0, *(len(d[1]) for d in decoded)])
        at = np.array([bases[r] + i for r, i, _ in order], np.int64)
        known = np.array([n for _, _, n in order], np.int64)
        sizes = np.concatenate([np.frombuffer(d[0].sizes, np.int32) for d in decoded])[at]
        counts = np.concatenate([np.frombuffer(d[0].counts, np.int32) for d in decoded])
        lefts, left_sizes = np.concatenate([d[3] for d in decoded])[at], np.concatenate([d[4] for d in decoded])[at]
        firsts = np.concatenate([[0], np.cumsum(counts)])
        k1, k2, x = (np.concatenate([np.frombuffer(d[0][c], np.int64) for d in decoded]) for c in (7, 8, 9))
        out = []
        for length in lengths:
            found = repeated_offsets(known, sizes, lefts, left_sizes, counts[at] == 1, replace(cut, length=length))
            edges = np.diff(found.astype(np.int8), axis=1, prepend=0, append=0)
            (entry, low), (_, high) = np.nonzero(edges == 1), np.nonzero(edges == -1)
            where = at[entry]
            copies = counts[where]
            member = np.repeat(firsts[where] - np.concatenate([[0], np.cumsum(copies)[:-1]]), copies) + np.arange(copies.sum())
            out.append(
                pd.DataFrame(
                    {
                        "_k1": k1[member],
                        "_k2": k2[member],
                        "length": np.full(len(member), length, np.int32),
                        "a": x[member] - np.repeat(high - 1, copies),
                        "b": x[member] - np.repeat(low, copies) + length,
                    }
                )
            )
        return pd.concat(out)

    return runs.groupBy("part").applyInPandas(merge, "_k1 long, _k2 long, length int, a long, b long")


def _spans(docs: DataFrame, cut: Cut, lengths: Sequence[int]) -> DataFrame:
    """_k1, _k2, spans array<struct<length,a,b>> of the rows with repeated strings. docs: keyed, text not null; lengths: that of ``cut`` or more."""
    spark = docs.sparkSession
    anchors = stored(_anchors(docs, cut), "anchors")
    again = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    with shuffles_released(spark):
        kept = stored(anchors.join(again, "h", "left_semi").groupBy(*_KEYS).agg(F.collect_list("x").alias("xs")), "anchors-again")
    dropped(anchors)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (kept.agg(F.sum(F.size("xs"))).first()[0] or 0) // MERGED)
    # All columns of docs come along: where the caller joins the same frame to the spans, Spark shuffles the texts once.
    runs = _runs(docs.join(kept, list(_KEYS)), parts, cut, max(lengths))
    return _merged(runs, cut, lengths).groupBy(*_KEYS).agg(F.collect_list(F.struct("length", "a", "b")).alias("spans"))


def united(spans, n: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that repeated strings of this length cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], min(s["b"], n)) for s in ([] if spans is None else spans) if s["length"] == length):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _bytes(spans: list[tuple[int, int]]) -> int:
    return sum(b - a for a, b in spans)


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for s in spans for e in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _worded(raw: bytes, runs: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """The runs with that many words (stretches without ASCII white space) or more."""
    return [(a, b) for a, b in runs if len(raw[a:b].split()) >= words]


def digests(docs: DataFrame, cut: Cut = CUT, passage: Cut = PASSAGE, words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, then n_passages and n_passage_bytes.

    Passages are the runs that ``remove(docs, passage, words)`` takes out; they leave the other columns as they are.
    """
    keyed = _keyed(texts(docs))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for keys, rows, found in pairs_of(batches, "doc_id", "text", "spans"):
            out = []
            for key, text, spans in zip(keys, rows, found, strict=True):
                raw = text.encode()
                runs = united(spans, len(raw), cut.length)
                passages = _worded(raw, united(spans, len(raw), passage.length), words)
                out.append((key, len(raw), _bytes(runs), len(runs), hashlib.sha256(_kept(raw, runs)).hexdigest(), len(passages), _bytes(passages)))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes"]
    kinds = [pa.string() if n == "kept_sha256" else pa.int64() for n in names]
    shorter = min(cut, passage, key=lambda c: c.length)
    spans = _spans(keyed, shorter, sorted({cut.length, passage.length}))
    joined = keyed.join(spans, list(_KEYS), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, ", ".join(f"{n} {'string' if n == 'kept_sha256' else 'long'}" for n in names))


def remove(docs: DataFrame, cut: Cut = CUT, words: int = 0) -> DataFrame:
    """The same rows and columns; a character goes if any of its bytes goes. n_chars, if present, follows.

    Runs of removable bytes with fewer than ``words`` words (stretches without ASCII white space) stay.
    """
    keyed = _keyed(docs)
    spans = _spans(keyed.select(*_KEYS, F.coalesce(F.col("text"), F.lit("")).alias("text")), cut, [cut.length])

    @F.pandas_udf("string")
    def left(column: pd.Series, found: pd.Series) -> pd.Series:
        def one(text, spans):
            raw = (text or "").encode()
            return _kept(raw, _worded(raw, united(spans, len(raw), cut.length), words)).decode("utf-8", "ignore")

        return pd.Series([one(t, s) for t, s in zip(column, found, strict=True)], dtype=object)

    texts(docs)
    out = keyed.join(spans, list(_KEYS), "left")
    out = out.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(left("text", "spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(docs.columns)
