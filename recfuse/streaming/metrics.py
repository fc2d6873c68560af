"""Metric roll-ups over event tables. The same functions serve batch tables and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recfuse import constants as C
from recfuse.functions.values import micros

SECOND = 1_000_000


def timed(events: DataFrame, ts: str, delay: str | None = None) -> DataFrame:
    """Event time as a UTC timestamp, with a watermark when the table is a stream."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, delay or "10 minutes") if events.isStreaming else out


def counters(events: DataFrame, ts: str, labels: Sequence[str], width: str = "1 minute", delay: str | None = None) -> DataFrame:
    """Events per label set and time window."""
    w = F.window(ts, width).alias("w")
    return (
        timed(events, ts, delay)
        .groupBy(w, *labels)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), *labels, "n")
    )


def histogram(events: DataFrame, labels: Sequence[str], value: str, buckets: str | Sequence[float]) -> DataFrame:
    """Cumulative bucket counts per label set: rows (labels, le, n), plus sum and count.

    One conditional sum per bucket in a single aggregate; nothing is exploded before it.
    """
    bounds = C.HISTOGRAM_BUCKETS[buckets] if isinstance(buckets, str) else list(buckets)
    v = F.col(value)
    per_bucket = [F.count_if(v <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    total = events.groupBy(*labels).agg(*per_bucket, F.count(v).alias("total"), F.sum(v).alias("value_sum"))
    rows = F.array(
        *[F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)],
        F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")),
    )
    return total.select(*labels, "total", "value_sum", F.inline(rows))


def gauges(events: DataFrame, ts: str, labels: Sequence[str], value: str, tie: Sequence[str] = ()) -> DataFrame:
    """Last value per label set. Of rows at the same instant the one with the greatest ``tie``
    columns counts, without them the greatest value. Rows without a time count only if all are."""
    order = F.struct(F.col(ts).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(tie)], F.col(value).alias("v"))
    last = events.groupBy(*labels).agg(F.max(order).alias("_last"), F.max(ts).alias("at"))
    return last.select(*labels, F.col("_last.v").alias("value"), "at")


def alerts(
    events: DataFrame,
    ts: str,
    labels: Sequence[str],
    failing: Column,
    width: str,
    slide: str,
    above: float,
    per_second: int | None = None,
    delay: str | None = None,
) -> DataFrame:
    """Windows in which failing events exceed a bound: an increase, or a rate over ``per_second``."""
    w = F.window(ts, width, slide).alias("w")
    counted = timed(events, ts, delay).filter(failing).groupBy(w, *labels).agg(F.count("*").alias("n"))
    level = F.col("n") / F.lit(float(per_second)) if per_second else F.col("n").cast("double")
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *labels, "n", level.alias("level")
    ).filter(F.col("level") > above)


def high_error_rate(events: DataFrame, ts: str, status_code: str, labels: Sequence[str] = ()) -> DataFrame:
    """More than 0.1 server errors per second over five minutes."""
    return alerts(events, ts, labels, F.col(status_code).startswith("5"), "5 minutes", "1 minute", 0.1, 300)


def repeated_failures(events: DataFrame, ts: str, failing: Column, labels: Sequence[str] = ()) -> DataFrame:
    """More than five failures over one hour."""
    return alerts(events, ts, labels, failing, "1 hour", "5 minutes", 5)


def held(fired: DataFrame, labels: Sequence[str], slide_s: int, hold_s: int) -> DataFrame:
    """Alert windows preceded by enough consecutive ones: the condition has held for ``hold_s``.

    Each window votes for itself and for the next ones; a window with all votes has held.
    """
    steps = hold_s // slide_s
    earlier = fired.select(*labels, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"), "window_end", "window_start", "n", "level")
    reach = earlier.groupBy(*labels, F.timestamp_add("SECOND", F.col("k") * slide_s, F.col("window_end")).alias("at")).agg(
        F.count("*").alias("hits"),
        F.max(F.when(F.col("k") == 0, F.struct("window_start", "window_end", "n", "level"))).alias("own"),
    )
    return reach.filter((F.col("hits") == steps + 1) & F.col("own").isNotNull()).select(*labels, "own.*")


def trailing(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    seconds: int,
    value: Column | None = None,
    include_start: bool = False,
    out: str = "trailing",
) -> DataFrame:
    """Count (or sum of ``value``) over the last ``seconds`` up to each row, per key.

    Time is cut into buckets of that length. What a row counts is the part of its own bucket up to
    it, a running total forward in time, and the part of the bucket before that hasn't expired,
    a running total backward over expiry marks that the earlier rows leave in the next bucket. Both
    frames only ever grow, so a bucket takes time in proportion to its rows, and nothing is
    subtracted. Rows of one instant count each other; rows without a time get null. Nulls in the
    keys are values. The start of the span is open unless ``include_start``.
    """
    width = seconds * SECOND
    e = events.withColumn("_at", micros(ts)).withColumn("_v", F.lit(1).cast("long") if value is None else value)
    bucket = F.floor(F.col("_at") / F.lit(width))
    marks = F.array(
        F.struct(bucket.alias("_b"), F.col("_at").alias("_pos"), F.lit(False).alias("_mark")),
        F.struct((bucket + 1).alias("_b"), (F.col("_at") + width).alias("_pos"), F.lit(True).alias("_mark")),
    )
    dated = e.filter("_at IS NOT NULL").select("*", F.inline(marks))
    part = Window.partitionBy(*keys, "_b")
    forward = part.orderBy("_pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # Of a mark and a row at the same instant, the mark has expired unless the start belongs to the span.
    tie = F.col("_mark").desc() if include_start else F.col("_mark")
    backward = part.orderBy(F.col("_pos").desc(), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.sum(F.when(~F.col("_mark"), F.col("_v"))).over(forward)
    earlier = F.sum(F.when(F.col("_mark"), F.col("_v"))).over(backward)
    counted = dated.withColumns({"_here": here, "_earlier": earlier}).filter(~F.col("_mark"))
    total = F.coalesce(F.col("_here") + F.col("_earlier"), "_here", "_earlier")
    undated = e.filter("_at IS NULL").withColumn(out, F.lit(None))
    columns = [c for c in events.columns if c != out]
    return counted.withColumn(out, total).select(*columns, out).unionByName(undated.select(*columns, out))


def rollup(
    events: DataFrame, ts: str, ok: Column, runtime: str, labels: Sequence[str] = (), width: str = "1 hour", delay: str | None = None
) -> DataFrame:
    """Requests or tasks per hour: total, successes, success rate, mean runtime."""
    w = F.window(ts, width).alias("w")
    counted = timed(events, ts, delay).groupBy(w, *labels).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.avg(runtime).alias("avg_runtime")
    )
    return counted.select(
        F.col("w.start").alias("hour"), *labels, "total", "ok", (F.col("ok") / F.col("total") * 100).alias("success_rate"), "avg_runtime"
    )


def log_tail(logs: DataFrame, ts: str, level: str, minimum: str = "INFO", n: int = 100, tie: str | None = None) -> DataFrame:
    """Newest ``n`` log entries at or above a level."""
    ranks = F.create_map(*[F.lit(x) for k, v in C.LOG_LEVELS.items() for x in (k, v)])
    kept = logs.filter(F.try_element_at(ranks, F.upper(F.col(level))) >= C.LOG_LEVELS[minimum])
    return kept.orderBy(F.col(ts).desc(), *([F.col(tie)] if tie else [])).limit(n)


def first_claims(claims: DataFrame, ts: str, keys: Sequence[str], delay: str = "7 days") -> DataFrame:
    """Drop repeats of a claim (same key, source and content) within the watermark of a stream."""
    content = F.xxhash64(*[c for c in claims.columns if c != ts])
    hashed = claims.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("content_hash", content)
    if claims.isStreaming:
        return hashed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, "content_hash"])
    rest = [c for c in hashed.columns if c not in (*keys, "content_hash")]
    first = hashed.groupBy(*keys, "content_hash").agg(F.min_by(F.struct(*rest), ts).alias("_r"))
    return first.select(*[F.col(c) if c in (*keys, "content_hash") else F.col(f"_r.{c}") for c in hashed.columns])
