"""Sliding-window admission: a request passes if fewer than ``limit`` passed in the last window.

Rejected requests use no quota, so the decision depends on earlier decisions and is taken in event
order. All that must be remembered per (identifier, endpoint) is at most ``limit`` instants.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recfuse import constants as C
from recfuse.functions.values import micros

SECOND = 1_000_000
LONGEST_WINDOW_S = max(C.DEFAULT_LIMIT[1], *[w for _, _, w in C.ENDPOINT_LIMITS])
#: Slots that a window is cut into, and slots among which a key's history is cut once at most.
SLOTS = 4
STRIDE = 64
DECISION = "allowed boolean, remaining int, retry_after int"


def endpoint_limits(spark: SparkSession) -> DataFrame:
    """The fixed per-endpoint limits: six rows."""
    return spark.createDataFrame(C.ENDPOINT_LIMITS, "endpoint string, max_requests int, window_s int")


def with_limits(requests: DataFrame, limits: DataFrame | None = None, endpoint: str = "endpoint") -> DataFrame:
    """Add each request's limit and window; endpoints without their own get the default."""
    # The built-in table is a constant of six rows; a caller's table is left to the planner.
    table = F.broadcast(endpoint_limits(requests.sparkSession)) if limits is None else limits
    named = table.select(F.col("endpoint").alias("_e"), F.col("max_requests").alias("_m"), F.col("window_s").alias("_w"))
    n, w = C.DEFAULT_LIMIT
    return (
        requests.join(named, F.col(endpoint) == F.col("_e"), "left")
        .withColumns({"max_requests": F.coalesce("_m", F.lit(n)), "window_s": F.coalesce("_w", F.lit(w))})
        .drop("_e", "_m", "_w")
    )


def _decide(passed: deque, at: int, limit: int, window: int) -> tuple[bool, int, int | None]:
    """One decision; ``passed`` holds the admitted instants still inside the window."""
    while passed and passed[0] <= at - window:
        passed.popleft()
    if len(passed) >= limit:
        wait = (passed[0] + window - at) // SECOND if passed else window // SECOND
        return False, 0, max(int(wait), 1)
    passed.append(at)
    return True, limit - len(passed), None


def _admit_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk rows sorted by (group, time), carrying the open group's state from batch to batch."""
    group, passed = None, deque()
    for pdf in batches:
        allowed, remaining, retry = [], [], []
        rows = zip(pdf["_group"], pdf["_at"], pdf["max_requests"], pdf["window_s"])
        for g, at, limit, window in rows:
            if g != group:
                group, passed = g, deque()
            a, r, w = _decide(passed, int(at), int(limit), int(window) * SECOND)
            allowed.append(a)
            remaining.append(r)
            retry.append(w)
        decided = pdf.assign(allowed=allowed, remaining=remaining, retry_after=pd.array(retry, dtype="Int32"))
        yield decided[~pdf["_warm"].to_numpy(bool)].drop(columns=["_group", "_at", "_warm"])


def admission_pieces(requests: DataFrame, keys: Sequence[str], width: int, stride: int = STRIDE) -> DataFrame:
    """Where each key's history is cut: rows (keys, slot, piece, warms), slots of a quarter ``width``.

    A request is surely admitted if no more than its limit were made in the last ``width`` at all. If
    that holds for every request of four slots in a row, what must be remembered after them is just
    these requests, whatever was decided before. So a piece may start after any four quiet (or empty)
    slots, and the requests of those slots warm it up. Each ``stride`` slots have one such start at
    most, which bounds the requests that are decided twice. ``requests`` has ``_at``, ``max_requests``.
    """
    slot = F.floor(F.col("_at") / F.lit(width // SLOTS)).alias("slot")
    counted = requests.groupBy(*keys, slot).agg(F.count("*").alias("n"), F.min("max_requests").alias("least"))
    ahead = Window.partitionBy(*keys).orderBy("slot")
    # Five slots hold every request of the last ``width`` before any request of the fifth.
    recent = F.sum("n").over(ahead.rangeBetween(-SLOTS, 0))
    loud = F.when(recent > F.coalesce("least", F.lit(0)), 1).otherwise(0)
    noisy = counted.withColumn("loud", loud)
    free = F.coalesce(F.max("loud").over(ahead.rangeBetween(-SLOTS, -1)), F.lit(0)) == 0
    strided = noisy.withColumn("free", free).withColumn("stride", F.floor(F.col("slot") / F.lit(stride)))
    first = F.min(F.when(F.col("free"), F.col("slot"))).over(Window.partitionBy(*keys, "stride"))
    cut = strided.withColumn("cut", F.coalesce(F.col("slot") == first, F.lit(False)))
    # A piece is named by its first slot; the requests before the first cut belong to the first one.
    started = F.when(F.col("cut"), F.col("slot"))
    piece = F.coalesce(F.last(started, True).over(ahead.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-(2**62)))
    # The next cut among the next four slots: two cuts may be nearer than that, at the border of two strides.
    warms = F.collect_list(started).over(ahead.rangeBetween(1, SLOTS))
    return cut.select(*keys, "slot", piece.alias("piece"), warms.alias("warms"))


def admit(
    requests: DataFrame,
    ts: str,
    seq: str,
    keys: Sequence[str] = ("identifier", "endpoint"),
    longest_window_s: int = LONGEST_WINDOW_S,
    stride: int = STRIDE,
) -> DataFrame:
    """Decide every request of a table that carries ``max_requests`` and ``window_s``.

    Decisions depend on earlier ones, so a piece of a key's history is decided in order; histories
    are cut wherever nothing before matters (``admission_pieces``), and pieces are decided in
    parallel. Inside a task rows stream past, with at most ``limit`` instants in memory. A key that
    stays above its limit all the time has no such place and is one stream.

    Nulls in the keys are values of their own. A request without a time can't be placed and is
    rejected, with ``retry_after`` null.
    """
    too_long = F.raise_error(F.lit(f"window_s exceeds longest_window_s={longest_window_s}"))
    timed = requests.withColumn("_at", micros(ts)).withColumn(
        "window_s", F.when(F.col("window_s") > longest_window_s, too_long.cast("int")).otherwise(F.col("window_s"))
    )
    dated = timed.filter("_at IS NOT NULL")
    width = longest_window_s * SECOND
    pieces = admission_pieces(dated, keys, width, stride).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [dated[k].eqNullSafe(pieces[f"_k{i}"]) for i, k in enumerate(keys)]
    slot = F.floor(F.col("_at") / F.lit(width // SLOTS)) == F.col("slot")
    own = F.struct(F.col("piece").alias("_piece"), F.lit(False).alias("_warm"))
    warm = F.transform("warms", lambda p: F.struct(p.alias("_piece"), F.lit(True).alias("_warm")))
    placed = dated.join(pieces, reduce(and_, same, slot)).select(*timed.columns, F.inline(F.concat(F.array(own), warm)))
    # Text that tells nulls, and where one part ends, apart.
    group = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "_piece"), {"ignoreNullFields": "false"})
    sorted_rows = (
        placed.withColumn("_group", group).drop("_piece").repartition("_group").sortWithinPartitions("_group", "_at", seq)
    )
    kept = [f for f in sorted_rows.schema.fields if f.name not in ("_group", "_at", "_warm")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + DECISION
    decided = sorted_rows.mapInPandas(_admit_sorted, schema)
    undated = timed.filter("_at IS NULL").select(
        *[f.name for f in kept], F.lit(False).alias("allowed"), F.lit(0).alias("remaining"), F.lit(None).cast("int").alias("retry_after")
    )
    return decided.unionByName(undated)


def active_limits(requests: DataFrame, ts: str, as_of, keys: Sequence[str] = ("identifier", "endpoint")) -> DataFrame:
    """Requests per key still inside their window, and the seconds until the last one leaves it."""
    start = micros(as_of) - F.col("window_s").cast("bigint") * SECOND
    live = requests.filter((micros(ts) > start) & (micros(ts) <= micros(as_of)))
    left = (F.max(micros(ts) + F.col("window_s").cast("bigint") * SECOND) - micros(as_of)) / F.lit(float(SECOND))
    return live.groupBy(*keys).agg(F.count("*").alias("current_requests"), F.ceil(left).alias("ttl"))


class _Limiter(StatefulProcessor):
    """Keeps the admitted instants of one key; an event-time timer drops them when all have expired."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._passed = handle.getListState("passed", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["at_us", "seq"], kind="stable")
        passed = deque(row[0] for row in self._passed.get()) if self._passed.exists() else deque()
        decided = [
            _decide(passed, int(at), int(limit), int(window) * SECOND)
            for at, limit, window in zip(pdf["at_us"], pdf["max_requests"], pdf["window_s"])
        ]
        self._passed.put([(at,) for at in passed])
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(int(pdf["at_us"].max() // 1000 + int(pdf["window_s"].max()) * 1000 + 1))
        yield pd.DataFrame(
            {
                "identifier": pdf["identifier"].to_numpy(),
                "endpoint": pdf["endpoint"].to_numpy(),
                "seq": pdf["seq"].to_numpy(),
                "allowed": [d[0] for d in decided],
                "remaining": pd.array([d[1] for d in decided], dtype="Int32"),
                "retry_after": pd.array([d[2] for d in decided], dtype="Int32"),
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._passed.clear()
        yield from ()

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, ts: str, delay: str = "1 minute") -> DataFrame:
    """Streaming form over (identifier, endpoint, seq, max_requests, window_s, ts)."""
    timed = requests.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("at_us", micros(ts)).withWatermark(ts, delay)
    return timed.groupBy("identifier", "endpoint").transformWithStateInPandas(
        statefulProcessor=_Limiter(),
        outputStructType=f"identifier string, endpoint string, seq bigint, {DECISION}",
        outputMode="Append",
        timeMode="EventTime",
    )
