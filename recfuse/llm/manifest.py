"""Merkle manifest of a documents table: leaf coordinates from bitmap ranks, trees by slot arrays.

Each row is a leaf; the leaves of a source ascend by doc_id and are reduced by threes to the source's
subroot, the subroots in the order of their sources to the root.

1. Each source's doc_ids are a bitmap, kept as its non-empty words of 64 ids. Tasks build words of
   what they read; equal words are merged by ``or`` and their row counts added.
2. The directory adds up counts: of words in a block of 64, of blocks in a superblock of 4096, and of
   superblocks in a source, each in windows of at most that many rows. The rank of an id is the sum
   of the counts before its word and the population count below its bit, so no leaves are sorted.
3. Leaves meet in arrays of 3**DEPTH slots, each in the slot that its rank says. A task
   reduces an array through all its levels at once; the nodes fill the slots of the next arrays.
4. On the way back each array learns the siblings above it, a few dozen digests, and every leaf gets
   the siblings of its own path.

Nulls: a null doc_id comes before all others, a null source too; null fields are written as ``-``;
a row without doc_id is never tampered with. Rows of one source with equal doc_ids are ordered by
their leaves; equal leaves are interchangeable. Long texts are hashed in their row, without Python.
An empty table gives no rows. Columns other than doc_id, source, lang, n_chars and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recfuse.llm.common import batched, stored

FAN = 3
#: Levels that an array of FAN**DEPTH slots is reduced by at once.
DEPTH = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of an id within its word, of a word within its block, of a block within its superblock.
WORD, BLOCK, SUPER = 6, 6, 12
#: The word of rows without doc_id: below every other.
_NO_ID = -(2 ** (63 - WORD)) - 1


def _field(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest (binary) of a row whose text is ``text``."""
    own = [text if name == "text" else F.col(name).cast("string") for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*map(_field, own)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """src, doc_id, word, low, leaf, other (the leaf after tampering, null if the same), piece (of the input)."""
    text = F.col("text")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & text.contains("\n")
    return docs.select(
        # Sorts bytewise, a null source first.
        F.coalesce(F.concat(F.lit("+"), "source"), F.lit("")).alias("src"),
        "doc_id",
        F.coalesce(F.shiftright(F.col("doc_id").cast("long"), WORD), F.lit(_NO_ID)).alias("word"),
        F.coalesce(F.col("doc_id").bitwiseAND(2**WORD - 1), F.lit(0)).cast("int").alias("low"),
        leaf(text).alias("leaf"),
        F.when(tampered, leaf(F.replace(text, F.lit("\n"), F.lit("")))).alias("other"),
        F.spark_partition_id().alias("piece"),
    )


def _before(count: str, *keys: str, order: list[str]) -> Column:
    """Sum of a count over the rows of the same keys that come before."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(window), F.lit(0))


def words(rows: DataFrame) -> DataFrame:
    """src, word, bits, n: the ids of each non-empty word as a bitmap, and the number of its rows."""
    bit = F.expr("shiftleft(1L, low)")
    return rows.groupBy("src", "word").agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n"))


def directory(bitmap: DataFrame) -> DataFrame:
    """src, word, bits, rank (rows of the source before the word), total (rows of the source)."""
    cut = bitmap.withColumn("block", F.shiftright("word", BLOCK))
    blocks = cut.groupBy("src", "block").agg(F.sum("n").alias("n")).withColumn("super", F.shiftright("block", SUPER))
    supers = blocks.groupBy("src", "super").agg(F.sum("n").alias("n"))
    supers = supers.select("src", "super", _before("n", "src", order=["super"]).alias("s"), F.sum("n").over(Window.partitionBy("src")).alias("total"))
    blocks = blocks.select("src", "block", "super", _before("n", "src", "super", order=["block"]).alias("b"))
    found = cut.select("src", "word", "block", "bits", _before("n", "src", "block", order=["word"]).alias("w"))
    found = found.join(blocks, ["src", "block"]).join(supers, ["src", "super"])
    return found.select("src", "word", "bits", (F.col("s") + F.col("b") + F.col("w")).alias("rank"), "total")


def _within(rows: DataFrame) -> DataFrame:
    """Rows with ``above``: how many rows of their word come before, also where ids repeat.

    Rows of one id are counted by the first bytes of their leaves, then by leaf and piece of the
    input, so no window holds more than one piece's equal rows or one part of the leaves.
    """
    rows = rows.withColumn("part", F.conv(F.hex(F.substring("leaf", 1, 2)), 16, 10).cast("int"))
    ids, parts, own = ["src", "word", "low"], ["src", "word", "low", "part"], ["src", "word", "low", "part", "leaf", "piece"]
    counts = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
    by_part = counts.groupBy(*parts).agg(F.sum("n").alias("n"))
    by_id = by_part.groupBy(*ids).agg(F.sum("n").alias("n"))
    out = rows.withColumn("k", F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(1))) - 1)
    out = out.join(counts.select(*own, _before("n", *parts, order=["leaf", "piece"]).alias("c")), own)
    out = out.join(by_part.select(*parts, _before("n", *ids, order=["part"]).alias("p")), parts)
    out = out.join(by_id.select(*ids, _before("n", "src", "word", order=["low"]).alias("i")), ids)
    return out.withColumn("above", F.col("k") + F.col("c") + F.col("p") + F.col("i")).drop("part", "k", "c", "p", "i")


def ranked(rows: DataFrame) -> DataFrame:
    """The leaves with rank (place in their source, from 0) and total. rows: a stored table of leaves."""
    bitmap = stored(words(rows), "words")
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, low)"))).cast("long")
    index = directory(bitmap)
    crowded = bitmap.where(F.col("n") > F.bit_count("bits")).select("src", "word")
    columns = [*rows.columns, "rank", "total"]
    if crowded.isEmpty():
        return rows.join(index, ["src", "word"]).withColumn("rank", F.col("rank") + below).select(columns)
    alone = rows.join(crowded, ["src", "word"], "left_anti").withColumn("above", F.lit(None).cast("long"))
    both = alone.unionByName(_within(rows.join(crowded, ["src", "word"], "left_semi")))
    return both.join(index, ["src", "word"]).withColumn("rank", F.col("rank") + F.coalesce("above", below)).select(columns)


def parent(nodes: list[bytes]) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def levels(total: int) -> int:
    """Levels between the leaves and the root of a tree."""
    n, size = 0, 1
    while size < total:
        n, size = n + 1, size * FAN
    return n


def climbed(nodes: list[bytes], total: int, depth: int) -> list[list[bytes]]:
    """The nodes of an array of a tree with ``total`` nodes at its level, and of each level above, up to one node."""
    out = [nodes]
    for _ in range(min(depth, levels(total))):
        below = out[-1]
        out.append([parent(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    return out


def path(tree: list[list[bytes]], slot: int) -> bytes:
    """Siblings from a slot up: of each level the numbers of those on the left and on the right, then their digests."""
    found = []
    for nodes in tree[:-1]:
        first = slot - slot % FAN
        left, right = nodes[first:slot], nodes[slot + 1 : first + FAN]
        found += [bytes([len(left), len(right)]), *left, *right]
        slot //= FAN
    return b"".join(found)


def siblings(way: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Left and right digests of each level of a path."""
    at = 0
    while at < len(way):
        left, right = 32 * way[at], 32 * way[at + 1]
        yield way[at + 2 : at + 2 + left], way[at + 2 + left : at + 2 + left + right]
        at += 2 + left + right


def folded(node: bytes, way: bytes) -> bytes:
    """The root that a node and the siblings of its path give."""
    for left, right in siblings(way):
        node = hashlib.sha256((left + node + right).hex().encode()).digest()
    return node


def _arrays(nodes: DataFrame, depth: int, *more: str) -> DataFrame:
    """Slot arrays of nodes (src, place, total, node and more): src, chunk, total, items."""
    slot = (F.col("place") % FAN**depth).cast("int").alias("slot")
    grouped = nodes.groupBy("src", F.expr(f"place div {FAN**depth}").alias("chunk"))
    return grouped.agg(F.first("total").alias("total"), F.collect_list(F.struct(slot, "node", *more)).alias("items"))


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, list[int], dict[str, list]]]:
    """Of each array in a batch: its row, and the columns of its items in the order of the slots."""
    items = batch.column("items")
    offsets, flat = items.offsets.to_pylist(), items.values
    names = [flat.type.field(k).name for k in range(flat.type.num_fields)]
    columns = [flat.field(k).to_pylist() for k in range(len(names))]
    for row in range(len(items)):
        a, b = offsets[row], offsets[row + 1]
        order = sorted(range(a, b), key=columns[0].__getitem__)
        yield row, {name: [column[k] for k in order] for name, column in zip(names, columns, strict=True)}


def _roots(arrays: DataFrame, depth: int) -> DataFrame:
    """The node of each array at its top: src, place, total, node."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = batch.column("total").to_pylist()
            tops = [climbed(own["node"], totals[row], depth)[-1][0] for row, own in _opened(batch)]
            columns = [batch.column("src"), batch.column("chunk"), pa.array([-(-t // FAN**depth) for t in totals], pa.int64()), pa.array(tops, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["src", "place", "total", "node"])

    return batched(arrays).mapInArrow(run, "src string, place long, total long, node binary")


def _paths(arrays: DataFrame, depth: int) -> DataFrame:
    """Of arrays with ``way`` (the path above them): src, place, way of each slot."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            src, chunk, total, way = (batch.column(n).to_pylist() for n in ("src", "chunk", "total", "way"))
            for row, own in _opened(batch):
                tree = climbed(own["node"], total[row], depth)
                found += [(src[row], chunk[row] * FAN**depth + k, path(tree, k) + way[row]) for k in range(len(tree[0]))]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["src", "place", "way"])

    return batched(arrays).mapInArrow(run, "src string, place long, way binary")


def _reduced(first: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Arrays of each round, the given ones first, and the tops: src, node."""
    rounds, done = [first], None
    while True:
        nodes = stored(_roots(rounds[-1], depth), "nodes")
        tops = nodes.where("total <= 1").select("src", "node")
        done = tops if done is None else done.union(tops)
        more = nodes.where("total > 1")
        if more.isEmpty():
            return rounds, done
        rounds.append(stored(_arrays(more, depth), "arrays"))


def _ways(rounds: list[DataFrame], tops: DataFrame, depth: int) -> DataFrame:
    """The arrays of the first round with way, the path above each. tops: src, way above each tree."""
    way = None
    for arrays in reversed(rounds):
        last = arrays.where(F.col("total") <= FAN**depth).join(tops, "src")
        own = last
        if way is not None:
            own = last.unionByName(arrays.where(F.col("total") > FAN**depth).join(way.withColumnRenamed("place", "chunk"), ["src", "chunk"]))
        if arrays is rounds[0]:
            return own
        way = stored(_paths(own, depth), "ways")
    raise ValueError("no rounds")


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    proof_sha256 is the digest of the siblings on the way from the leaf to the root. Every second row
    (by its doc_id's checksum) is tampered with by deleting line feeds; folded_root is what the
    tampered leaf and the original siblings give.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    rows = stored(leaves(docs), "leaves")
    placed = ranked(rows).select("src", F.col("rank").alias("place"), "total", F.col("leaf").alias("node"), "doc_id", "other")
    rounds, subroots = _reduced(stored(_arrays(placed, depth, "doc_id", "other"), "arrays"), depth)

    # Subroots in the order of their sources: rows are numbered in ranges, then by the ranges' counts.
    numbered = subroots.repartitionByRange("src").sortWithinPartitions("src").withColumn("id", F.monotonically_increasing_id())
    numbered = stored(numbered.select("src", "node", F.shiftright("id", 33).alias("range"), F.col("id").bitwiseAND(2**33 - 1).alias("k")), "subroots")
    ranges = numbered.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("all").orderBy("range")
    ranges = ranges.withColumn("all", F.lit(0)).select(
        "range",
        F.coalesce(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    sources = stored(numbered.join(ranges, "range").select("src", "node", (F.col("before") + F.col("k")).alias("place"), "total"), "sources")
    top_rounds, top = _reduced(stored(_arrays(sources.select(F.lit("").alias("src"), "place", "total", "node"), depth), "arrays"), depth)
    found = top.select("node").first()
    if found is None:
        return spark.createDataFrame([], schema)
    root = bytes(found["node"])
    above = spark.createDataFrame([("", bytearray())], "src string, way binary")
    tops = _paths(_ways(top_rounds, above, depth), depth).select("place", "way")
    tops = stored(sources.join(tops, "place").select("src", "way", F.col("node").alias("subroot")), "tops")
    ready = _ways(rounds, tops.select("src", "way"), depth).join(tops.select("src", "subroot"), "src")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, above, subroot = (batch.column(n).to_pylist() for n in ("total", "way", "subroot"))
            out: list[tuple] = []
            for row, own in _opened(batch):
                tree, known = climbed(own["node"], total[row], depth), {}
                for k, (node, other, doc_id) in enumerate(zip(own["node"], own["other"], own["doc_id"], strict=True)):
                    near = path(tree, k)
                    proof = hashlib.sha256("".join((a + b).hex() for a, b in siblings(near + above[row])).encode()).hexdigest()
                    top_node = folded(node if other is None else other, near)
                    if top_node not in known:
                        known[top_node] = folded(top_node, above[row])
                    end = known[top_node]
                    out.append((doc_id, node.hex(), subroot[row].hex(), root.hex(), proof, end.hex(), end == root))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = [batch.schema.field("items").type.value_type.field("doc_id").type, *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return batched(ready).mapInArrow(run, schema)
