"""Streaming jobs over split files, compared with the batch answer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recfuse.schema import LAUNCH_FIELDS, SOURCE_FIELDS
from recfuse.sources.readers import read_claims, stream_claims
from recfuse.streaming import limiter as LM
from recfuse.streaming import metrics as ME
from recfuse.streaming.ingest import CurationSink

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture()
def split_events(spark, tmp_path):
    """The event table cut into files by time, in time order."""
    path = str(tmp_path / "events")
    e = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    # A far-future row closes every window of an append-mode stream.
    closing = {"ts": F.lit(dt.datetime(2030, 1, 1)), "event_type": F.lit("error")}
    last = e.limit(1).select(*[closing.get(c, F.lit(None).cast(t)).alias(c) for c, t in e.dtypes])
    e.repartitionByRange(4, "ts").write.parquet(path)
    last.coalesce(1).write.mode("append").parquet(path)
    return path, e


def _drain(df, name, tmp_path, mode="append"):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.table(name)


def _rows(df, *cols):
    return sorted(tuple(str(v) for v in r) for r in df.select(*cols).collect())


def test_counters_stream_equals_batch(spark, split_events, tmp_path):
    path, batch = split_events
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = _drain(ME.counters(stream, "ts", ["event_type"], "1 hour", "40 days"), "counters", tmp_path)
    want = ME.counters(batch, "ts", ["event_type"], "1 hour")
    cols = ("window_start", "event_type", "n")
    assert _rows(got, *cols) == _rows(want, *cols)


def test_histogram_stream_equals_batch(spark, split_events, tmp_path):
    path, batch = split_events
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = _drain(ME.histogram(stream, ["event_type"], "value", "tasks"), "hist", tmp_path, "complete")
    cols = ("event_type", "le", "n")
    assert _rows(got, *cols) == _rows(ME.histogram(batch, ["event_type"], "value", "tasks"), *cols)


def test_alert_stream(spark, split_events, tmp_path):
    path, batch = split_events
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rule = lambda df, d=None: ME.alerts(df, "ts", [], F.col("event_type") == "error", "1 hour", "30 minutes", 1, delay=d)
    got = _drain(rule(stream, "40 days"), "alerts", tmp_path)
    assert _rows(got, "window_start", "n") == _rows(rule(batch), "window_start", "n")


def test_held_alerts(spark):
    ends = [dt.datetime(2024, 1, 1, 0, m) for m in (1, 2, 3, 7, 8)]
    fired = spark.createDataFrame([(e - dt.timedelta(minutes=5), e, 9, 1.0) for e in ends], "window_start timestamp, window_end timestamp, n long, level double")
    assert [r.window_end.minute for r in ME.held(fired, [], 60, 120).collect()] == [3]


def test_first_claims_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", "s", 1, "2024-01-01 00:00:00"), ("a", "s", 1, "2024-01-02 00:00:00"), ("a", "s", 2, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "k string, s string, v int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(src)
    df.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = _drain(ME.first_claims(stream, "ts", ["k", "s"]), "firsts", tmp_path)
    assert sorted(r.v for r in got.collect()) == [1, 2]


def _requests(spark, rows, limit, window):
    df = spark.createDataFrame(rows, "identifier string, endpoint string, seq long, at double")
    ts = F.timestamp_micros((F.lit(1_700_000_000_000_000) + F.col("at") * 1_000_000).cast("bigint"))
    return df.select("identifier", "endpoint", "seq", ts.alias("ts"), F.lit(limit).alias("max_requests"), F.lit(window).alias("window_s"))


LIMIT_CASES = [
    # limit 5 in 60 s: the sixth is blocked
    ([("u", "/t", i, float(i)) for i in range(6)], 5, 60, [(True, 4), (True, 3), (True, 2), (True, 1), (True, 0), (False, 0)]),
    # the window slides
    ([("u", "/t", 0, 0.0), ("u", "/t", 1, 0.1), ("u", "/t", 2, 0.2), ("u", "/t", 3, 0.3), ("u", "/t", 4, 2.1)], 3, 2,
     [(True, 2), (True, 1), (True, 0), (False, 0), (True, 1)]),
    # keys are independent; rejected requests use no quota
    ([("a", "/t", 0, 0.0), ("a", "/t", 1, 1.0), ("a", "/t", 2, 2.0), ("b", "/t", 3, 2.0), ("a", "/t", 4, 60.5)], 2, 60,
     [(True, 1), (True, 0), (False, 0), (True, 1), (True, 0)]),
]


@pytest.mark.parametrize("rows,limit,window,want", LIMIT_CASES)
def test_admit_batch(spark, rows, limit, window, want):
    out = LM.admit(_requests(spark, rows, limit, window), "ts", "seq").orderBy("seq").collect()
    assert [(r.allowed, r.remaining) for r in out] == want
    assert all((r.retry_after or 0) >= 1 for r in out if not r.allowed)


@pytest.mark.parametrize("case", [0, 2])
def test_admit_stream(spark, tmp_path, case):
    rows, limit, window, want = LIMIT_CASES[case]
    src = str(tmp_path / "req")
    df = _requests(spark, rows, limit, window)
    # Two files, so that state is carried from one batch to the next.
    df.filter("seq < 3").coalesce(1).write.parquet(src)
    df.filter("seq >= 3").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = _drain(LM.admit_stream(stream, "ts", "1 hour"), f"admit{case}", tmp_path).orderBy("seq").collect()
    assert [(r.allowed, r.remaining) for r in got] == want


def _walk_requests(rows, limit, window):
    """Decisions by walking every key's requests in order. rows: (identifier, endpoint, seq, at in seconds)."""
    passed, out = {}, {}
    for who, where, seq, at in sorted(rows, key=lambda r: (r[3], r[2])):
        live = passed.setdefault((who, where), [])
        live[:] = [x for x in live if x > at - window]
        out[seq] = (len(live) < limit, max(limit - len(live) - 1, 0))
        if len(live) < limit:
            live.append(at)
    return out


def test_admit_equals_a_walk(spark):
    """Quiet and loud stretches, ties, silences, null keys in either place: cut into pieces or not."""
    import random

    rng = random.Random(11)
    rows, seq = [], 0
    for who, where in (("a", "/x"), ("a", None), (None, "a"), (None, None)):
        at = 0.0
        for k in range(900):
            at += rng.choice([0, 0, 1, 2, 3]) if k // 60 % 3 == 0 else rng.choice([5, 12, 20, 45]) if k % 97 else 400
            rows.append((who, where, seq, at))
            seq += 1
    for stride in (LM.STRIDE, 4, 10_000):
        out = LM.admit(_requests(spark, rows, 5, 60), "ts", "seq", longest_window_s=60, stride=stride).collect()
        assert {r.seq: (r.allowed, r.remaining) for r in out} == _walk_requests(rows, 5, 60) and len(out) == len(rows)


def test_a_never_silent_key_is_cut(spark):
    """Ten minutes between requests, a hundred an hour allowed: hundreds of pieces, few requests decided twice."""
    rows = spark.range(20_000).selectExpr("'u' AS identifier", "id * 600000000L AS _at", "100 AS max_requests")
    pieces = LM.admission_pieces(rows, ["identifier"], 3600 * LM.SECOND)
    found = pieces.agg(F.countDistinct("piece"), F.sum(F.size("warms"))).first()
    assert found[0] > 100 and found[1] < 0.1 * 20_000
    loud = LM.admission_pieces(rows.withColumn("max_requests", F.lit(3)), ["identifier"], 3600 * LM.SECOND)
    assert loud.select("piece").distinct().count() == 1


def test_requests_without_a_time_are_rejected(spark):
    df = _requests(spark, [("u", "/t", 0, None), ("u", "/t", 1, 1.0)], 1, 60)
    assert {r.seq: (r.allowed, r.remaining, r.retry_after) for r in LM.admit(df, "ts", "seq").collect()} == {0: (False, 0, None), 1: (True, 0, None)}


@pytest.mark.parametrize("include_start", [False, True])
def test_trailing_equals_a_walk(spark, include_start):
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(-300, 300)]), rng.choice([None, 1.5, 2.25, -4.0])) for i in range(900)]
    df = spark.createDataFrame(rows, "seq long, k string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    inside = lambda x, at: (at - 10 <= x if include_start else at - 10 < x) and x <= at
    span = lambda r: [x for x in rows if x[1] == r[1] and x[2] is not None and inside(x[2], r[2])]
    counts = {r.seq: r.n for r in ME.trailing(df, ["k"], "ts", 10, None, include_start, "n").collect()}
    assert counts == {r[0]: None if r[2] is None else len(span(r)) for r in rows}
    sums = {r.seq: r.n for r in ME.trailing(df, ["k"], "ts", 10, F.col("v"), include_start, "n").collect()}
    values = lambda r: [x[3] for x in span(r) if x[3] is not None]
    assert sums == {r[0]: None if r[2] is None or not values(r) else sum(values(r)) for r in rows}


def test_trailing_takes_linear_time(spark):
    """Twice the rows of one key, all inside the span of each other, take about twice the time."""
    import time

    def took(n):
        df = spark.range(n).select(F.lit("k").alias("k"), F.timestamp_micros(F.col("id") * 1000).alias("ts"))
        start = time.time()
        total = ME.trailing(df, ["k"], "ts", 3600).agg(F.sum("trailing")).first()[0]
        return time.time() - start, total

    took(1000)
    small, large = took(20_000), took(40_000)
    assert large[1] == 40_000 * 40_001 // 2 and large[0] < 3 * small[0] + 2


def test_last_values_with_ties(spark):
    df = spark.createDataFrame([("a", 1, 1, 5.0), ("a", 1, 2, 3.0), ("b", None, 1, 1.0)], "k string, t int, seq int, v double")
    got = {r.k: r.value for r in ME.gauges(df, "t", ["k"], "v", ["seq"]).collect()}
    assert got == {"a": 3.0, "b": 1.0} and {r.k: r.value for r in ME.gauges(df, "t", ["k"], "v").collect()}["a"] == 5.0


def test_window_longer_than_declared_fails(spark):
    df = _requests(spark, [("u", "/t", 0, 0.0)], 1, 7200)
    with pytest.raises(Exception, match="longest_window_s"):
        LM.admit(df, "ts", "seq").collect()


def _claim(seq, source, quality, **over):
    raw = {"slug": "heavy-demo", "mission_name": "Heavy Demo", "launch_date": "2024-02-06 20:45:00", "vehicle_type": "Falcon Heavy",
           "payload_mass": "1420", "orbit": "LEO", "status": "success", "details": None, "mission_patch_url": None, "webcast_url": None, **over}
    src = {"source_name": source, "source_url": "https://s.example/x", "scraped_at": "2024-02-07 00:00:00", "data_quality_score": str(quality)}
    return (tuple(raw[f] for f in LAUNCH_FIELDS), tuple(src[f] for f in SOURCE_FIELDS), seq)


def test_incremental_ingest(spark, tmp_path):
    from recfuse.schema import RAW

    src, root = str(tmp_path / "claims"), str(tmp_path / "curated")
    first = [_claim(1, "wikipedia", 0.7, mission_name="Heavy Test", orbit=None), _claim(2, "nasa", 0.9, slug="crew-8", mission_name="Crew-8"),
             _claim(3, "nasa", 0.9, slug="bad", status="bogus")]
    second = [_claim(4, "spacex", 0.95, payload_mass="1000")]
    spark.createDataFrame(first, RAW).coalesce(1).write.json(src)
    sink = CurationSink(spark, root, F.lit(dt.datetime(2024, 3, 1)), key_parts=4)

    def run():
        q = (stream_claims(spark, src, "json", 1).writeStream.foreachBatch(sink)
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    rows = {r.slug: r for r in sink.tables.read("launches").collect()}
    assert set(rows) == {"heavy-demo", "crew-8"} and rows["heavy-demo"].mission_name == "Heavy Test"
    spark.createDataFrame(second, RAW).coalesce(1).write.mode("append").json(src)
    run()
    rows = {r.slug: r for r in sink.tables.read("launches").collect()}
    assert rows["heavy-demo"].mission_name == "Heavy Demo" and float(rows["heavy-demo"].payload_mass) == 1000
    assert rows["heavy-demo"].orbit == "LEO" and rows["crew-8"].mission_name == "Crew-8"
    assert sink.tables.read("sources").count() == 3 and sink.tables.read("claims").count() == 3
    fields = {r.field_name for r in sink.tables.read("conflicts").collect()}
    assert "payload_mass" in fields
    runs = sink.tables.read("runs").orderBy("batch").collect()
    assert [(r.input_records, r.validated_records, r.created, r.updated) for r in runs] == [(3, 2, 2, 0), (1, 1, 0, 1)]
    # A repeated batch changes nothing.
    version = sink.tables.version()
    sink(read_claims(spark, src), runs[-1].batch)
    assert sink.tables.version() == version


def test_batches_touch_their_partitions_only(spark, tmp_path):
    """A batch replaces the partitions of its keys; the others stay in the commit that made them."""
    from recfuse.schema import RAW

    root = str(tmp_path / "curated")
    sink = CurationSink(spark, root, F.lit(dt.datetime(2024, 3, 1)), key_parts=16, most_commits=3)
    rows = [_claim(i, "nasa", 0.9, slug=f"crew-{i}", mission_name=f"Crew-{i}") for i in range(40)]
    sink(spark.createDataFrame(rows, RAW), 0)
    before = sink.tables.commits("launches")
    assert len(before) > 8 and {tuple(v) for v in before.values()} == {(1,)}
    sink(spark.createDataFrame([_claim(100, "spacex", 0.95, slug="crew-7", mission_name="Crew Seven")], RAW), 1)
    after = sink.tables.commits("launches")
    changed = [p for p in after if after[p] != before[p]]
    assert len(changed) == 1 and after[changed[0]] == [2] and sink.tables.commits("claims")[changed[0]] == [1, 2]
    assert {r.slug: r.mission_name for r in sink.tables.read("launches").collect()} == {f"crew-{i}": "Crew Seven" if i == 7 else f"Crew-{i}" for i in range(40)}
    # Resolved conflicts don't come back, and many commits of a partition become one.
    tables = sink.tables
    resolved = tables.read("conflicts").withColumn("resolved", F.lit(True))
    tables.commit(replace={"conflicts": resolved})
    known = tables.read("conflicts").count()
    for batch in (2, 3):
        sink(spark.createDataFrame([_claim(100 + batch, "spacex", 0.95, slug="crew-7", mission_name="Crew Seven")], RAW), batch)
    assert known and tables.read("conflicts").count() == known and tables.read("conflicts").filter("resolved").count() == known
    assert tables.read("claims").count() == 43 and len(tables.commits("claims")[changed[0]]) == 1
    assert [r.batch for r in tables.read("runs").orderBy("batch").collect()] == [0, 1, 2, 3] and len(tables.commits("runs")[""]) <= 3


def test_a_commit_is_published_once(spark, tmp_path):
    """The second of two writers that began from the same commit fails and leaves the tables as they are."""
    from recfuse.sources.snapshots import SnapshotTables

    df = spark.createDataFrame([(1,)], "a int")
    first, second = (SnapshotTables(spark, str(tmp_path / "db"), {"t": df.schema}) for _ in range(2))
    second.stage("t", df)
    second.version = lambda: 0
    first.commit(append={"t": df})
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        second.commit(staged_append=["t"])
    assert first.version() == 1 and first.read("t").count() == 1 and not [n for n in first._names(f"{tmp_path}/db/commits") if not n.startswith("_") and n != "1.json"]
