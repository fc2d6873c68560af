"""Near-duplicate classes: documents linked when the Jaccard similarity of their word n-grams is 0.8 or more.

Words are stretches without ASCII white space, A-Z lower-cased; a document's set has its distinct
five-word shingles (as 64-bit hashes), or its whole sequence if it has fewer words. Every link is
found or follows from others; pairs inside a class are not listed.

1. Documents with equal sets become one node.
2. Two linked nodes share one of their first n - ceil(0.8 n) + 1 shingles in any common order. The
   order puts shingles that tasks meet often last, the most often met at the end, so shared passages
   seldom bring documents together. The order changes only the work: the list of frequent shingles
   has a fixed bound.
3. In each group of a shared shingle of up to GROUP nodes all pairs are listed that sizes and the
   places of the shingle allow; in a larger one every node is paired with the least one (frequent
   shingles salted, then joined by the least of each salt): a number of pairs linear in the rows.
   These are verified and give first classes; a small group is settled with them.
4. Nodes that a chain of large groups joins but verified pairs don't are indexed by the counts of
   their shingles in hash groups. Pages of nodes, ordered by size, form the leaves of an R-tree: the
   overlap of a query with anything below a box is at most the sum of the minima of the query's
   counts and the box's upper corner. Pages whose sizes can't match never meet; pairs in one class
   are skipped. Of the surviving pairs a page lists a spanning forest only: it says which nodes can
   still be linked to each other, in chains much shorter than those of step 2.
5. These shorter chains are paged with their whole sets and indexed by finer counts (a group for two
   shingles). A task verifies surviving pairs on the spot and merges the classes it knows, so it
   writes no more links than it has nodes. First each page meets itself and its neighbour. Where a
   chain still has several classes, all its pages meet, but for two pages of its largest class.

The R-tree alone can't deal work out at scale: counts of unlike long texts differ too little for
its boxes to prune, so step 2 brings together what may be linked.

Null and empty texts, and texts without words, have empty sets: they are linked with nothing and
are their own component. Repeated rows share a component. Columns other than doc_id and text are
ignored by ``classes`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recfuse.llm.common import dropped, pairs_of, stored, texts
from recfuse.llm.components import components, extended

NGRAM = 5
PERCENT = 80
#: Bound on the list of frequent shingles (9 bytes each).
FREQUENT = 1 << 20
#: Shingles a task counts together, and how often it must meet one.
COUNTED = 4_000_000
MET = 2
SALTS = 32
#: Nodes of a shared shingle that all meet each other.
GROUP = 64
#: Steps of a doubling in which counts of frequent shingles are told apart.
STEPS = 4
LEAST_DIMENSIONS, MOST_DIMENSIONS, FINE_DIMENSIONS = 64, 2048, 8192
#: Shingles that fill a page of whole sets, how many times as many fill one of points, and how many more each node counts.
PAGE, OF_POINTS, ROW = 1 << 18, 8, 256
LEAF = 16
#: So many nodes are looked up by a broadcast (about 40 bytes each); more of them by a shuffle of the texts.
BROADCAST_NODES = 200_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_NONE = -(2**63)


def shingles(text: str) -> np.ndarray:
    """The set of a text: sorted distinct 64-bit hashes."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    if n < NGRAM:
        out = (h * _MIX[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)
    else:
        out = sum((h[k : n - NGRAM + 1 + k] * _MIX[k] for k in range(1, NGRAM)), h[: n - NGRAM + 1] * _MIX[0])
    out = (out ^ (out >> np.uint64(32))) * _MIX[1]
    return np.unique(out ^ (out >> np.uint64(29)))


@dataclass(frozen=True)
class Frequent:
    """Frequent shingles, sorted, and how often each is met, in steps of a doubling."""

    shingle: np.ndarray
    level: np.ndarray


def prefix(found: np.ndarray, frequent: Frequent) -> np.ndarray:
    """The first shingles in the common order; the lowest bit says whether a shingle is frequent."""
    n = len(found)
    if not n:
        return found
    level = np.zeros(n, np.uint8)
    if len(frequent.shingle):
        at = np.minimum(np.searchsorted(frequent.shingle, found), len(frequent.shingle) - 1)
        often = frequent.shingle[at] == found
        level[often] = frequent.level[at[often]]
    keys = np.where(level > 0, found | np.uint64(1), found & ~np.uint64(1))
    return keys[np.argsort(level, kind="stable")[: n - (PERCENT * n + 99) // 100 + 1]]


def _frequent(docs: DataFrame) -> Frequent:
    """Shingles that tasks met several times together, over all documents; no more than FREQUENT of the most frequent."""

    def counted(kept: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(kept), return_counts=True)
        often = counts >= MET
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["s", "n"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for (rows,) in pairs_of(batches, "text"):
            for text in rows:
                kept.append(shingles(text))
                size += len(kept[-1])
                if size >= COUNTED:
                    yield counted(kept)
                    kept, size = [], 0
        if kept:
            yield counted(kept)

    def packed(batches) -> Iterator[pa.RecordBatch]:
        # Two values of a task, not a row for each shingle.
        kept = [(b.column("s").to_numpy().tobytes(), b.column("level").to_numpy().astype(np.uint8).tobytes()) for b in batches]
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(x[k] for x in kept)], pa.binary()) for k in (0, 1)], ["s", "level"])

    met = texts(docs).select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    met = stored_met = stored(met, "met")
    # How many shingles are met how often, the often met first; up to the bound.
    met = met.select("s", F.floor(F.log2("n") * STEPS).cast("short").alias("level"))
    of = met.groupBy("level").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("level")).collect()
    least, total = 1 << 14, 0
    for row in of:
        total += row["c"]
        if total > FREQUENT:
            break
        least = row["level"]
    rows = met.where(F.col("level") >= least).mapInArrow(packed, "s binary, level binary").collect()
    dropped(stored_met)
    found, level = np.frombuffer(b"".join(r["s"] for r in rows), np.uint64), np.frombuffer(b"".join(r["level"] for r in rows), np.uint8)
    order = np.argsort(found)
    return Frequent(found[order], level[order])


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), n, d1, d2 (digest of the set), keys, point of every document."""
    frequent = _frequent(docs)

    def run(batches) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for ids, hashes, rows in pairs_of(batches, "doc_id", "hash", "text"):
            sizes, digests, keys, points = [], [], [], []
            for text in rows:
                found = shingles(text)
                sizes.append(len(found))
                digests.append(xxh3_128_intdigest(found.tobytes()))
                keys.append(prefix(found, frequent))
                points.append(point(found))
            offsets = np.cumsum([0, *map(len, keys)])
            flat = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            halves = (np.array([(d >> s) & (2**64 - 1) for d in digests], np.uint64).view(np.int64) for s in (64, 0))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (ids, hashes, sizes)), *map(pa.array, halves), flat, pa.array(points, pa.binary())], ["doc_id", "hash", "n", "d1", "d2", "keys", "point"])

    return texts(docs).withColumn("hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, hash long, n long, d1 long, d2 long, keys array<long>, point binary")


def _links(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs a, b: those of small groups that sizes and places allow, and each node of a large group with the least one; linear in the rows. And the stored table behind them."""
    rows = nodes.select("node", "n", F.posexplode("keys").alias("at", "key"))
    rows = rows.withColumn("salt", F.when(F.col("key") % 2 == 0, 0).otherwise(F.pmod("node", F.lit(SALTS))).cast("int"))
    own = Window.partitionBy("key", "salt")
    led = rows.withColumns({"b": F.min("node").over(own), "size": F.count(F.lit(1)).over(own)})
    # Frequent shingles are counted on over their salts.
    led = stored(led.where((F.col("size") > 1) | (F.col("key") % 2 != 0)).select("key", "node", "n", "at", "b", "size"), "led")
    rare, often = led.where(F.col("key") % 2 == 0), led.where(F.col("key") % 2 != 0)
    heads = often.where("node = b").groupBy("key").agg(F.sum("size").alias("total"), F.min("b").alias("least"))
    often = often.join(heads, "key")
    small = rare.where(F.col("size") <= GROUP).union(often.where(F.col("total").between(2, GROUP)).select(rare.columns))
    one, other = (small.select("key", *(F.col(c).alias(f"{c}{k}") for c in ("node", "n", "at"))) for k in (1, 2))
    # So many shingles can be shared if this one is the first shared one; the one that is lets its pair pass.
    left = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    pairs = one.join(other, "key").where((F.col("node1") > F.col("node2")) & (100 * left >= PERCENT * (F.col("n1") + F.col("n2") - left)))
    large = often.where(F.col("total") > GROUP)
    heads = large.where("node = b").select("node", F.col("least").alias("b"))
    star = rare.where(F.col("size") > GROUP).select("node", "b").union(large.select("node", "b")).union(heads).where("node <> b")
    return pairs.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct(), star.distinct().select(F.col("node").alias("a"), "b"), led


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, items: the whole sets of the given nodes (node, first_id, first_hash, d1, d2) as bytes, made again from the texts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for ids, d1, d2, rows in pairs_of(batches, "node", "d1", "d2", "text"):
            keep, sets = [], []
            for node, hi, lo, text in zip(ids, d1, d2, rows, strict=True):
                found = shingles(text)
                # Another text may share the doc_id and, by chance, the hash.
                if xxh3_128_intdigest(found.tobytes()) == ((hi & (2**64 - 1)) << 64 | lo & (2**64 - 1)):
                    keep.append(node)
                    sets.append(found)
            columns = [pa.array(keep, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "items"])

    own = texts(docs).select(F.coalesce("doc_id", F.lit(_NONE)).alias("first_id"), F.xxhash64("text").alias("first_hash"), "text")
    few = nodes.count() <= BROADCAST_NODES
    found = own.join(F.broadcast(nodes) if few else nodes, ["first_id", "first_hash"]).select("node", "d1", "d2", "text")
    return found.mapInArrow(run, "node long, n long, items binary").dropDuplicates(["node"])


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs a, b that the bound doesn't rule out."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("point").alias("xa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("point").alias("xb"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("na", "xa", "nb", "xb"))
            keep = [may_link(n, m, int(np.minimum(*alike(unpacked(x), unpacked(y))).sum(dtype=np.int64))) for n, x, m, y in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    sized = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    return sized.select("a", "b", "na", "xa", "nb", "xb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are as similar as asked."""
    pairs = stored(pairs, "pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(_sets(docs, nodes.select("node", "first_id", "first_hash", "d1", "d2").join(asked, "node", "left_semi")), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(as_set(x), as_set(y)) for x, y in zip(batch.column("ia").to_pylist(), batch.column("ib").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ia", "ib").mapInArrow(run, "a long, b long")


def as_set(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) are as similar as asked."""
    return may_link(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True)))


def point(found: np.ndarray) -> bytes:
    """How many shingles fall into each hash group; the number of groups, a power of two, follows the size."""
    groups = LEAST_DIMENSIONS
    while groups < MOST_DIMENSIONS and 8 * groups < len(found):
        groups *= 2
    return np.minimum(np.bincount((found & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 65535).astype("<u2").tobytes()


def fine_point(found: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((found & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2")


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """The same points with fewer groups (the last axis)."""
    return points.reshape(*points.shape[:-1], -1, groups).sum(axis=-2, dtype=np.int64) if points.shape[-1] > groups else points


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    groups = min(a.shape[-1], b.shape[-1])
    return folded(a, groups), folded(b, groups)


def may_link(n, m, bound):
    """Whether sets of n and m elements may be as similar as asked if they share no more than the bound."""
    return 100 * bound >= PERCENT * (n + m - bound)


def _near(pa_, na, ca, pb, nb, cb) -> Iterator[tuple[int, np.ndarray]]:
    """For queries a, the places in a tree of b whose bound reaches the limit and whose classes differ."""
    leaves = range(0, len(nb), LEAF)
    pa_, pb = alike(pa_, pb)
    corners = np.array([pb[i : i + LEAF].max(axis=0) for i in leaves])
    least = np.array([nb[i : i + LEAF].min() for i in leaves])
    most = np.array([nb[i : i + LEAF].max() for i in leaves])

    def reach(bound, n, m):
        # The most similar sets of n and of m or more elements that share no more than the bound.
        bound = np.minimum(bound, n)
        return 100 * bound >= PERCENT * (n + np.maximum(m, bound) - bound)

    for i in range(len(na)):
        boxes = np.flatnonzero(reach(np.minimum(corners, pa_[i]).sum(axis=1, dtype=np.int64), na[i], least) & (100 * most >= PERCENT * na[i]))
        if len(boxes):
            at = (boxes[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < len(nb)]
            at = at[cb[at] != ca[i]]
            bound = np.minimum(np.minimum(pb[at], pa_[i]).sum(axis=1, dtype=np.int64), np.minimum(nb[at], na[i]))
            yield i, at[may_link(na[i], nb[at], bound)]


def survivors(pa_, na, ca, pb, nb, cb) -> Iterator[tuple[int, int]]:
    """Pairs of places whose bound reaches the limit and whose classes differ: queries a against a tree of b."""
    for i, near in _near(pa_, na, ca, pb, nb, cb):
        yield from ((i, j) for j in near.tolist())


class Page:
    """Nodes of a chain with their classes, sizes and points; with whole sets (column items) or points (column point)."""

    def __init__(self, rows: list[dict]):
        self.node = np.array([r["node"] for r in rows], np.int64)
        self.root = np.array([r["root"] for r in rows], np.int64)
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.sets = [as_set(r["items"]) for r in rows] if "items" in rows[0] else None
        groups = LEAST_DIMENSIONS
        while self.sets and groups < FINE_DIMENSIONS and 2 * groups < self.n.max():
            groups *= 2
        points = [fine_point(x, groups) for x in self.sets] if self.sets else [unpacked(r["point"]) for r in rows]
        least = min(map(len, points))
        self.points = np.array([folded(x, least) for x in points], np.int32)


def forest(a: Page, b: Page) -> Iterator[tuple[int, int]]:
    """Node pairs that join what is apart: verified ones where both pages have sets, else surviving ones.

    Pairs of one class, and pairs that earlier pairs of these pages join already, are skipped.
    """
    nodes, at = np.unique(np.concatenate([a.node, b.node]), return_inverse=True)
    group = np.empty(len(nodes), np.int64)
    group[at] = np.concatenate([a.root, b.root]) if a.sets else at
    at_a, at_b = at[: len(a.node)], at[len(a.node) :]
    for i, near in _near(a.points, a.n, a.root, b.points, b.n, b.root):
        for j in near[group[at_b[near]] != group[at_a[i]]].tolist():
            own, other = group[at_a[i]], group[at_b[j]]
            if own != other and (not a.sets or similar(a.sets[i], b.sets[j])):
                group[group == other] = own
                yield int(a.node[i]), int(b.node[j])


def _paged(state: DataFrame, *order: str, times: int = 1) -> DataFrame:
    """state (node, n, chain, ...) with a page number: a chain cut by size where its shingles fill a page."""
    filled = F.sum(F.col("n") + ROW).over(Window.partitionBy("chain").orderBy(*order, "n", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return state.withColumn("page", F.floor(filled / (times * PAGE)))


def _forests(placed: DataFrame, column: str, meet: str) -> DataFrame:
    """a, b: the forests of all page pairs that fulfil ``meet`` (columns page, page2, main, main2) and whose sizes can match.

    placed: node, n, chain, page, main, root and the named column.
    """
    rows = F.array_sort(F.collect_list(F.struct("n", "node", "root", column)))
    pages = placed.groupBy("chain", "page").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("main").alias("main"), rows.alias("rows"))
    pages = stored(pages, "pages")
    first = pages.select("chain", "page", "main", "least", "most")
    second = first.toDF("chain", "page2", "main2", "least2", "most2")
    sizes = f"100 * most >= {PERCENT} * least2 and 100 * most2 >= {PERCENT} * least"
    # Small keys meet first, rows follow.
    which = first.join(second, "chain").where(f"page2 >= page and {sizes} and ({meet})").select("chain", "page", "page2")
    met = which.join(pages.select("chain", "page", "rows"), ["chain", "page"])
    alone = met.where("page = page2").select("rows", F.lit(None).cast(pages.schema["rows"].dataType).alias("rows2"))
    other = pages.select("chain", F.col("page").alias("page2"), F.col("rows").alias("rows2"))
    met = alone.union(met.where("page < page2").join(other, ["chain", "page2"]).select("rows", "rows2"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a = Page(batch.column("rows")[k].as_py())
                second = batch.column("rows2")[k].as_py()
                found = list(forest(a, Page(second) if second else a))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _classed(state: DataFrame, roots: DataFrame) -> DataFrame:
    """state (node, n, chain) of the chains that have several classes, with the root of each node's class."""
    named = state.select("node", "n", "chain").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named, "state")
    several = named.groupBy("chain").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("chain")
    return named.join(several, "chain", "left_semi")


def _rest(links: DataFrame, sure: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: verified pairs that join the classes (sure: node, root) which the pairs verified first leave apart; links join what may be."""
    chains = stored(components(links), "chains")
    left = _classed(chains.withColumnRenamed("root", "chain").join(nodes.select("node", "n"), "node"), sure)
    placed = _paged(left, times=OF_POINTS).withColumn("main", F.lit(False)).join(nodes.select("node", "point"), "node")
    linkable = stored(_forests(placed, "point", "true"), "linkable")
    short = stored(components(linkable).withColumnRenamed("root", "chain").join(nodes.select("node", "n"), "node"), "short")
    sets = stored(_sets(docs, nodes.select("node", "first_id", "first_hash", "d1", "d2").join(short, "node", "left_semi")), "sets").select("node", "items")

    left = _classed(short, sure)
    placed = _paged(left).withColumn("main", F.lit(False)).join(sets, "node")
    found = stored(_forests(placed, "items", "page2 <= page + 1"), "found")
    # Chains with several classes and pages that have not met.
    far = left.groupBy("chain").agg(F.sum(F.col("n") + ROW).alias("filled")).where(F.col("filled") >= 2 * PAGE).select("chain")
    left = _classed(left.join(far, "chain", "left_semi"), extended(sure, found))
    largest = left.groupBy("chain", "root").count().groupBy("chain").agg(F.max_by("root", F.struct("count", "root")).alias("_main"))
    left = left.join(largest, "chain").withColumn("main", F.col("root") == F.col("_main")).drop("_main")
    parted = _paged(left, "main")
    # A page with nodes of other classes too is no page of the largest class: main is the least value of its nodes.
    return found.union(_forests(parted.join(sets, "node"), "items", "not (main and main2)"))


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and d1, d2, root, first of every node: first is the least row (null ids last) of the root's component."""
    signed = stored(_signed(docs), "signed")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    found = signed.where("n > 0").groupBy("d1", "d2").agg(F.min(row).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("point").alias("point"))
    found = found.withColumn("first_id", F.coalesce("first.doc_id", F.lit(_NONE))).withColumn("first_hash", F.col("first.hash"))
    nodes = stored(found.withColumn("node", F.monotonically_increasing_id()), "nodes")
    pairs, links, led = _links(nodes.select("node", "n", "keys"))
    pairs, links = stored(pairs, "listed"), stored(links, "links")
    dropped(led)
    sure = stored(components(_verified(_possible(pairs.union(links).distinct(), nodes), docs, nodes)), "sure")
    more = stored(_rest(links, sure, docs, nodes), "more")
    roots = stored(extended(sure, more), "roots")
    dropped(pairs, links, sure, more)
    named = nodes.select("d1", "d2", "node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    return signed, named.select("d1", "d2", "root").join(least, "root")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach; null if all of them are) of every row."""
    signed, named = _named(docs)
    named = named.select("d1", "d2", F.col("first.doc_id").alias("component_id"))
    out = signed.drop("keys", "point").join(named, ["d1", "d2"], "left")
    whole = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), whole.alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the least doc_id (null ids last, equal ids by a hash of the text); all rows without words. Columns as they are."""
    _, named = _named(docs)
    firsts = named.select(F.coalesce("first.doc_id", F.lit(_NONE)).alias("_k1"), F.col("first.hash").alias("_k2")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = text.rlike(r"[^ \t\n\x0B\f\r]")
    keyed = docs.where(worded).withColumn("_k1", F.coalesce("doc_id", F.lit(_NONE))).withColumn("_k2", F.xxhash64(text))
    # Repeated rows share the key: one row of those stays.
    out = keyed.join(firsts, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    return out.select(docs.columns).union(docs.where(~worded))
