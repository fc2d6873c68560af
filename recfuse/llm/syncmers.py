"""Document fingerprints of closed syncmers, with DataFrame functions only.

A k-mer is ``K`` words in a row. It is a closed syncmer if the least of its ``S``-word substrings
(by hash) is its first or its last one. Whether a k-mer is chosen depends on its own words alone, so
equal stretches of two texts choose the same anchors. A fingerprint lists the anchors' hashes with
their word positions; likeness matches equal anchors by position: of the anchors that two
fingerprints share (each hash at its first position), those displaced alike count, over all
different anchors of both.

Only a text of ``SURE`` = 2K-S-1 words or more has an anchor in any case. In shorter ones K shrinks to
S+1, where every k-mer is a closed syncmer; texts of S words or fewer have one anchor, the hash of all
their words. A short text and a longer one are compared by the k-mers of S+1 words of both; those of
the longer one are kept below 2 SURE words, above which less than half of it can be shared: likeness 0.
Null and empty texts have the same fingerprint, of no words. Equal texts have equal fingerprints, likeness 1. Repeated rows are
fingerprinted each on their own. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recfuse.llm.common import stored, texts

K = 12
S = 2
#: So many words hold a closed syncmer in any case.
SURE = 2 * K - S - 1
_SPACE = r"\s+"
_NONE = -(2**63)


def _anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add column ``name``: struct of the hashes (h) and the word positions (i) of the text's closed syncmers, and the hashes of all k-mers of S+1 words (s) of a text below 2 SURE words."""
    inner = K - S  # place of the last substring
    df = df.withColumn("_w", F.transform(F.split(text, _SPACE), lambda w: F.xxhash64(w)))
    pairs = F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - (S - 1), F.lit(0))), lambda h, i: F.xxhash64(h, F.get("_w", i + 1)))
    df = df.withColumn("_s", pairs)

    def least(h, i, others):
        """Whether h is least; most comparisons are not reached."""
        return reduce(and_, (h <= F.get("_s", i + k) for k in others))

    def closed(h, i):
        return least(h, i, range(1, inner + 1)) | least(F.get("_s", i + inner), i, range(inner - 1, -1, -1))

    firsts = F.slice("_s", 1, F.greatest(F.size("_s") - inner, F.lit(0)))
    df = df.withColumn("_i", F.array_compact(F.transform(firsts, lambda h, i: F.when(closed(h, i), i))))
    hash_of = lambda w: F.shiftright(F.xxhash64(w), 32).cast("int")
    hashes = F.transform("_i", lambda i: hash_of(F.slice("_w", i + 1, K)))
    n = F.size("_w")
    small = F.transform(F.slice("_w", 1, F.greatest(n - S, F.lit(0))), lambda w, i: hash_of(F.slice("_w", i + 1, S + 1)))
    none = F.array().cast("array<int>")
    df = df.withColumn("_f", F.when(n >= 2 * SURE, none).when(n <= S, F.array(hash_of("_w"))).otherwise(small))
    df = df.withColumn("_h", F.when(n < SURE, F.col("_f")).otherwise(hashes)).withColumn("_i", F.when(n < SURE, _places("_f")).otherwise(F.col("_i")))
    return df.withColumn(name, F.struct(F.col("_h").alias("h"), F.col("_i").alias("i"), F.col("_f").alias("s"))).drop("_w", "_s", "_i", "_h", "_f")


def _places(hashes: str) -> Column:
    return F.transform(hashes, lambda h, i: i)


def fingerprint(anchors: str) -> Column:
    """Anchors as text: hexadecimal hash and position, joined."""
    one = lambda h, i: F.concat(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit("@"), i.cast("string"))
    return F.array_join(F.zip_with(f"{anchors}.h", f"{anchors}.i", one), " ")


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Add column ``name``: share of anchors that match at one displacement, 0 to 1."""
    short = lambda x: F.col(f"{x}.h") == F.col(f"{x}.s")
    used = lambda x: F.when(short(a) == short(b), F.struct(f"{x}.h", f"{x}.i")).otherwise(F.struct(F.col(f"{x}.s").alias("h"), _places(f"{x}.s").alias("i")))
    df = df.withColumn("_ua", used(a)).withColumn("_ub", used(b))
    a, b = "_ua", "_ub"
    df = df.withColumn("_both", F.array_intersect(f"{a}.h", f"{b}.h")).withColumn("_all", F.size(F.array_union(f"{a}.h", f"{b}.h")))
    # Shared anchors in hash order, each at its first position, in both lists: the lists go in step.
    listed = lambda x: F.zip_with(f"{x}.h", f"{x}.i", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = lambda x: F.sort_array(F.filter(listed(x), lambda e: F.array_contains("_both", e["h"])))
    df = df.withColumn("_x", F.when(F.size("_both") > 0, ordered(a))).withColumn("_y", F.when(F.size("_both") > 0, ordered(b)))
    first = lambda c: F.filter(c, lambda e, k: (k == 0) | (F.get(c, k - 1)["h"] != e["h"]))
    df = df.withColumn("_x", first("_x")).withColumn("_y", first("_y"))
    df = df.withColumn("_d", F.sort_array(F.zip_with("_x", "_y", lambda x, y: y["i"] - x["i"])))
    start = F.struct(F.lit(None).cast("int").alias("d"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def count(s, d):
        run = F.when(d.eqNullSafe(s["d"]), s["run"] + 1).otherwise(1)
        return F.struct(d.alias("d"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    best = F.coalesce(F.aggregate("_d", start, count, lambda s: s["best"]), F.lit(0))
    return df.withColumn(name, F.when(F.col(a) == F.col(b), 1.0).otherwise(best / F.col("_all"))).drop("_ua", "_ub", "_both", "_all", "_x", "_y", "_d")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every whole text."""
    return _anchors(texts(docs), "text", "_a").select("doc_id", fingerprint("_a").alias("fingerprint"))


def _rows(docs: DataFrame) -> DataFrame:
    """Whole texts with a key for rows: the same for repeated rows, different for rows that share a doc_id only."""
    return texts(docs).select(F.coalesce("doc_id", F.lit(_NONE)).alias("_k1"), F.xxhash64("text").alias("_k2"), "text")


def _copy(df: DataFrame) -> DataFrame:
    """Number the copies of a repeated row, which are all alike."""
    return df.withColumn("_t", F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k1")))


def befores(rows: DataFrame) -> DataFrame:
    """_k1, _k2, _t and the key (_p1, _p2, _pt) and half length of the row before, by descending doc_id; the last comes before the first.

    Only keys move. They are dealt by ranges, and only the first row of each range needs one from another range.
    """
    keys = _copy(rows.select("_k1", "_k2", F.floor(F.length("text") / 2).cast("int").alias("_half")))
    down = lambda *by: Window.partitionBy(*by).orderBy(F.desc("_k1"), "_k2", "_t")
    dealt = keys.repartitionByRange(F.desc("_k1"), F.col("_k2")).withColumn("_p", F.spark_partition_id())
    placed = stored(dealt.withColumn("_n", F.row_number().over(down("_p"))), "placed")
    this = ("_k1", "_k2", "_t", "_half")
    # One row per range, as many as the ranges that were dealt.
    lasts = placed.groupBy("_p").agg(F.max_by(F.struct(*this), "_n").alias("_last"))
    order = Window.orderBy("_p")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = lasts.select("_p", F.coalesce(F.lag("_last").over(order), F.last("_last").over(whole)).alias("_last"))
    before = F.lag(F.struct(*this)).over(down("_p"))
    out = placed.withColumn("_b", before).join(F.broadcast(lasts), "_p").withColumn("_b", F.coalesce("_b", "_last"))
    return out.select("_k1", "_k2", "_t", *(F.col(f"_b.{c}").alias(n) for c, n in zip(this, ("_p1", "_p2", "_pt", "_half"), strict=True)))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every whole text.

    The next text is the next one by descending doc_id (equal ids by text; the first follows the
    last). The edited text has its last half replaced by as much of the beginning of the next text.
    Of the next text only that much travels, and its anchors.
    """
    rows = _rows(docs)
    own = _copy(_anchors(rows, "text", "_fa"))  # both uses share one exchange
    sent = befores(rows).withColumnRenamed("_t", "_u")
    # The copies' numbers are compared, but not join keys: so both sides stay dealt by the key.
    same = lambda a, b: (F.col(a) - F.col(b)).between(0, 0)
    heads = own.join(sent, ["_k1", "_k2"]).where(same("_t", "_u")).select(
        F.col("_p1").alias("_k1"), F.col("_p2").alias("_k2"), "_pt", F.substring(F.col("text"), F.lit(1), F.col("_half")).alias("_head"), F.col("_fa").alias("_fn")
    )
    n = F.length("text")
    both = own.join(heads, ["_k1", "_k2"]).where(same("_t", "_pt"))
    both = both.withColumn("_e", F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")), F.col("_head")))
    out = _anchors(both.select(F.when(F.col("_k1") != _NONE, F.col("_k1")).alias("doc_id"), n.cast("long").alias("n_chars"), "_e", "_fa", "_fn"), "_e", "_fe")
    out = out.select("doc_id", "n_chars", F.sha2("_e", 256).alias("edited_sha256"), "_fa", "_fe", "_fn")
    out = likeness(likeness(out, "_fa", "_fe", "near_edited"), "_fa", "_fn", "near_next")
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprint("_fa").alias("fingerprint"), fingerprint("_fe").alias("edited_fingerprint"), "near_edited", "near_next")
