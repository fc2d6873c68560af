"""Packing token pieces into sequences by column generation for the cutting-stock problem.

Each document is cut into pieces of the whole sequence length and one rest. Lengths are rounded up
to units; the histogram of units (at most ``UNITS`` numbers, whatever the corpus) goes to the
driver. There a linear program over patterns (how many pieces of each unit share a sequence) is
solved by column generation: the duals of the current patterns price new ones by an unbounded
knapsack recursion, until no pattern pays. The pattern counts are rounded down, the few pieces left
are placed first-fit decreasing, and the pieces of each unit, ranked, are dealt to the patterns.

A document without text has only its end id. Repeated rows are packed each on their own. An empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recfuse.llm.bpe import codec
from recfuse.llm.common import pairs_of, stored, texts
from recfuse.llm.words import WordCodec

#: Units a sequence is divided into. The unit is SEQUENCE / UNITS tokens.
UNITS = 128
SEQUENCE = 2048
#: Pieces of a unit that one task ranks, about.
RANKED_TOGETHER = 200_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best multiset of items (sizes positive) that fits into the room, by dynamic programming over the room."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = np.searchsorted(sizes, c, side="right")  # sizes ascend
        best[c] = best[c - 1]
        if fits:
            gain = best[c - sizes[:fits]] + values[:fits]
            i = int(np.argmax(gain))
            if gain[i] > best[c] + 1e-12:
                best[c], take[c] = gain[i], i
    counts, c = np.zeros(len(sizes), int), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= sizes[take[c]]
    return float(best[room]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one per column) and how often each is used, minimising the number of sequences.

    Revised simplex; the basis is as large as there are sizes, at most UNITS.
    """
    m = len(sizes)
    patterns = np.diag((room // sizes).astype(float))
    inverse, used = np.diag(1 / np.diag(patterns)), demand / np.diag(patterns)
    for _ in range(100 * m + 1000):
        value, column = knapsack(sizes, inverse.sum(axis=0), room)
        if value <= 1 + 1e-7:
            break
        along = inverse @ column
        ratios = np.full(m, np.inf)
        np.divide(used, along, out=ratios, where=along > 1e-9)
        out = int(np.argmin(ratios))
        step = ratios[out]
        used = used - step * along
        used[out] = step
        pivot = inverse[out] / along[out]
        inverse = inverse - np.outer(along, pivot)
        inverse[out] = pivot
        patterns[:, out] = column
    return patterns.astype(int), np.maximum(used, 0)


def plan(histogram: dict[int, int], room: int = UNITS) -> list[tuple[dict[int, int], int]]:
    """Patterns {units: pieces} with how many sequences follow each; every counted piece has exactly one place."""
    left = {u: n for u, n in sorted(histogram.items()) if n > 0}
    made = [({room: 1}, left.pop(room))] if room in left else []
    if left:
        sizes, demand = np.array(list(left)), np.array(list(left.values()), float)
        patterns, used = column_generation(sizes, demand, room)
        for k in range(len(sizes)):
            times = int(used[k] + 1e-6)
            column = {int(sizes[i]): int(n) for i, n in enumerate(patterns[:, k]) if n}
            times = min([times, *(left[u] // n for u, n in column.items())]) if column else 0
            if times:
                made.append((column, times))
                for u, n in column.items():
                    left[u] -= n * times
    while any(left.values()):  # first-fit decreasing, a whole sequence at a time
        column, space = {}, room
        for u in sorted(left, reverse=True):
            if n := min(left[u], space // u):
                column[u], space = n, space - n * u
        times = min(left[u] // n for u, n in column.items())
        made.append((column, times))
        for u, n in column.items():
            left[u] -= n * times
    return made


def runs(made: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each unit, which ranks go where: units, first rank, rank behind the last, pieces per sequence, first sequence, first slot."""
    placed: dict[int, int] = {}
    out, sequence = [], 0
    for column, times in made:
        slot = 0
        for u in sorted(column, reverse=True):
            a = placed.get(u, 0)
            b = placed[u] = a + column[u] * times
            out.append((u, a, b, column[u], sequence, slot))
            slot += column[u]
        sequence += times
    return out


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, sequence: int = SEQUENCE) -> DataFrame:
    """Encode every whole text, append the end id, cut: one row per piece with the checksum of its ids."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = codec(WordCodec, tokenizer, end_id)
        for keys, rows in pairs_of(batches, "doc_id", "text"):
            out: list[tuple] = []
            for key, text in zip(keys, rows, strict=True):
                ids = own.encode(text)
                n = len(ids) // 4
                for a in range(0, n, sequence):
                    b = min(a + sequence, n)
                    out.append((key, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b]), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return texts(docs).mapInArrow(run, PIECES)


def assign(cut: DataFrame, sequence: int = SEQUENCE, units: int = UNITS) -> DataFrame:
    """Give every piece (doc_id, start, length and any other columns) its sequence_id and offset."""
    spark = cut.sparkSession
    cut = cut.withColumn("_u", F.ceil(F.col("length") * units / sequence).cast("int"))
    histogram = {r["_u"]: r["n"] for r in cut.groupBy("_u").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `units` rows
    salts = max(histogram.values(), default=0) // RANKED_TOGETHER + 1
    salted = cut.withColumn("_s", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("_u", "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_u", "_s", F.coalesce(F.sum("_n").over(Window.partitionBy("_u").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    ranked = (
        salted.withColumn("_r", F.row_number().over(Window.partitionBy("_u", "_s").orderBy("doc_id", "start")) - 1)
        .join(before, ["_u", "_s"])
        .withColumn("_r", F.col("_r") + F.col("_b"))
    )
    # A few rows per unit and pattern: bounded by the number of units, not by the corpus.
    places = spark.createDataFrame(runs(plan(histogram, units)), "_u int, _from long, _to long, _per long, _first long, _slot long")
    placed = (
        ranked.join(F.broadcast(places), "_u")
        .where((F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to")))
        .withColumn("_k", F.col("_r") - F.col("_from"))
        .withColumn("sequence_id", F.col("_first") + F.floor(F.col("_k") / F.col("_per")))
        .withColumn("_slot", F.col("_slot") + F.col("_k") % F.col("_per"))
    )
    inside = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop(
        "_u", "_s", "_r", "_b", "_from", "_to", "_per", "_first", "_slot", "_k"
    )


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece. Encodes once."""
    return assign(stored(pieces(docs, tokenizer, end_id, sequence), "pieces"), sequence)
