"""The streaming jobs give the rows of their batch twins."""

import tempfile

import pandas as pd
from pyspark.sql import functions as F

from cuemill.operators.intervals import frame_spans
from cuemill.plans import all_queries
from cuemill.plans.parallel import audit_events
from cuemill.plans.streams import frames, percents, reports
from cuemill.sources.tables import cache_log, speech
from cuemill.streaming import progress as st

SF = "/root/testdata/sf0.001"


def as_stream(spark, df, parts=3, order=None):
    """The rows of a table as a file stream of several micro-batches."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = df.orderBy(*order) if order else df
    listed = rows.toPandas()
    step = max(1, -(-len(listed) // parts))
    for i in range(parts):
        piece = listed.iloc[i * step:(i + 1) * step]
        if len(piece):
            spark.createDataFrame(piece, df.schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def run(query, mode):
    name = "t" + tempfile.mkdtemp(prefix="spark-", dir="/tmp").rsplit("-", 1)[1].replace("_", "u")
    stream = query.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    stream.awaitTermination(180)
    assert stream.exception() is None
    return name


def rows(df):
    return sorted(map(tuple, df.collect()))


def plain_alerts(listed):
    """Alerts by a plain walk over all reports of each process."""
    found = []
    for proc, own in listed.groupby("proc_id"):
        state, samples = st.FRESH, []
        for now, poll in own.sort_values(["arrived_ms", "seq"], kind="stable").groupby("arrived_ms", sort=True):
            last = poll.iloc[-1]
            state, samples, alert = st.observe(state, samples, int(now), poll.out_ms.tolist(), int(last.total_ms), int(last.budget_ms), int(last.get("future_ms", 0)))
            if alert:
                found.append((int(proc), *alert))
    return sorted(found)


FAR = [(-1, 0, 10**12, 0, 1, 1)]


def test_deadline_alerts_over_any_batches(spark):
    source = reports(spark, SF)
    want = plain_alerts(source.toPandas())
    assert want and rows(all_queries()["s1_deadline_risk"].build(spark, SF)) == want
    # in batches whose rows overlap in time, with polls cut in two
    order = F.col("arrived_ms") + F.xxhash64("proc_id", "seq") % 20_000
    mixed = source.withColumn("o", order).unionByName(spark.createDataFrame([(*FAR[0], 10**12)], source.schema.add("o", "long"))).orderBy("o").drop("o")
    name = run(st.deadline_alerts(as_stream(spark, mixed, 3), delay="60 seconds"), "append")
    assert rows(spark.table(name)) == want


def test_deadline_state_is_dropped_and_media_to_come_counts(spark):
    schema = "proc_id long, seq long, arrived_ms long, out_ms long, total_ms long, budget_ms long, future_ms long"
    slow = [(1, k, 4_000 * k, 100 * k, 10_000, 90_000, 0) for k in range(12)]
    calm = [(2, k, 4_000 * k, 900 * k, 10_000, 90_000, 0) for k in range(12)]
    ahead = [(3, k, 4_000 * k, 900 * k, 10_000, 90_000, 60_000) for k in range(12)]
    again = [(1, 100 + k, 10_000_000 + 4_000 * k, 100 * k, 10_000, 10_090_000, 0) for k in range(12)]  # after it was forgotten
    table = spark.createDataFrame(slow + calm + ahead + again + [(*FAR[0], 0)], schema)
    name = run(st.deadline_alerts(as_stream(spark, table, 3, ["arrived_ms", "seq"]), expire_ms=600_000), "append")
    found = rows(spark.table(name))
    assert [(r[0], r[1] >= 10_000_000) for r in found] == [(1, False), (1, True), (3, False)]
    first = [r for r in plain_alerts(table.filter("arrived_ms < 1000000").toPandas())]
    assert [r for r in found if r[1] < 10_000_000] == first


def test_progress_state(spark):
    name = run(st.progress_state(as_stream(spark, percents(spark, SF))), "complete")
    assert rows(spark.table(name)) == rows(st.progress_state(percents(spark, SF)))


def test_latest_stage(spark):
    name = run(st.latest_stage(as_stream(spark, audit_events(spark, SF))), "complete")
    assert rows(spark.table(name)) == rows(st.latest_stage(audit_events(spark, SF)))


def test_closed_intervals(spark):
    few = frames(spark, SF).filter("media_id < 5")
    far = spark.createDataFrame([(-1, 10_000_000)], few.schema)
    stream = as_stream(spark, few, 2, ["frame"])
    late = as_stream(spark, few.unionByName(far), 3, ["frame"])
    assert stream.isStreaming
    name = run(st.closed_intervals(late), "append")
    assert rows(spark.table(name)) == rows(st.closed_intervals(few))


def test_closed_intervals_of_spans(spark):
    few = frame_spans(speech(spark, SF), ["media_id"]).filter("media_id < 5")
    far = spark.createDataFrame([(-1, 10_000_000, 10_000_001)], few.schema)
    late = as_stream(spark, few.unionByName(far), 3, ["frame"])
    name = run(st.closed_intervals(late, until="until"), "append")
    assert rows(spark.table(name)) == rows(st.closed_intervals(frames(spark, SF).filter("media_id < 5")))


def test_log_merge(spark):
    log = cache_log(spark, SF)
    snapshot = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    stream = as_stream(spark, log, 3, ["seq"])
    query = stream.writeStream.foreachBatch(st.merge_log(spark, snapshot, ["cue_ix", "target"])).option(
        "checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    last = query.lastProgress["batchId"]
    got = lambda e=None: rows(st.current_log(spark, snapshot, log.schema, e).select("cue_ix", "target", "seq", "translation"))
    assert got() == got(last) == rows(all_queries()["e14_log_compaction"].build(spark, SF))
    # removing what no kept generation reads changes nothing
    st.drop_generations(spark, snapshot, keep=1)
    assert got() == rows(all_queries()["e14_log_compaction"].build(spark, SF))


def test_log_merge_rewrites_touched_buckets_and_survives_failures(spark):
    snapshot = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    merge = st.merge_log(spark, snapshot, ["key"], buckets=8)
    batch = lambda *r: spark.createDataFrame(list(r), "key long, seq long, is_valid boolean, value string")
    merge(batch(*[(k, k, True, f"a{k}") for k in range(40)]), 0)
    first = st._places(spark, snapshot)
    merge(batch((1, 100, True, "b1"), (2, 101, False, "b2")), 1)
    second = st._places(spark, snapshot)
    assert sum(first[b] != second[b] for b in first) <= 2 and set(first) == set(second)
    want = {k: f"a{k}" for k in range(40) if k != 2} | {1: "b1"}
    current = lambda e=None: {r.key: r.value for r in st.current_log(spark, snapshot, batch().schema, e).collect()}
    assert current() == want and current(0) == {k: f"a{k}" for k in range(40)}
    merge(batch((3, 200, True, "other")), 1)  # the marker stands: nothing changes
    assert current() == want
    # rows without a marker, as a lost driver leaves them, are not read and are written over
    batch((5, 300, True, "torn")).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{snapshot}/rows/epoch=2")
    assert current() == want
    merge(batch((6, 301, True, "c6"), (1, 50, True, "old")), 2)  # and an older record does not win
    assert current() == want | {6: "c6"}
    merge(batch(), 3)
    assert current() == want | {6: "c6"}
    assert st.drop_generations(spark, snapshot, keep=1) == [e for e in range(3) if e not in st._places(spark, snapshot).values()]
    assert current() == want | {6: "c6"}


def test_poll_rules():
    state, samples = st.FRESH, []
    for now, out in ((0, 1), (12_000, 10)):
        state, samples, alert = st.observe(state, samples, now, [out], 10_000, 60_000)
    assert samples == [(12_000, 10)]  # the gap cleared the first sample
    state, samples, alert = st.observe(state, samples, 13_000, [5], 10_000, 60_000)
    assert state[4] and not samples and alert is None  # output went back: no evidence any more


class _Calls:
    """A state of one process that counts the messages which Spark would send."""

    def __init__(self):
        self.value, self.listed, self.timers, self.sent = None, [], [], 0

    def getValueState(self, name, schema):
        return self

    def getListState(self, name, schema):
        return _Listed(self)

    def registerTimer(self, at):
        self.sent += 1
        self.timers.append(at)

    def exists(self):
        self.sent += 1
        return self.value is not None

    def get(self):
        self.sent += 1
        return self.value

    def update(self, value):
        self.sent += 1
        self.value = value

    def clear(self):
        self.update(None)


class _Listed:
    def __init__(self, calls):
        self.calls, self.rows = calls, []

    def exists(self):
        self.calls.sent += 1
        return bool(self.rows)

    def get(self):
        self.calls.sent += 1
        return iter(self.rows)

    def appendList(self, rows):
        self.calls.sent += len(rows)
        self.rows += rows

    def put(self, rows):
        self.calls.sent += len(rows)
        self.rows = rows

    def clear(self):
        self.calls.sent += 1
        self.rows = []


class _At:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at

    def getCurrentWatermarkInMs(self):
        return self.at + 1


def test_messages_are_by_batch_and_not_by_poll():
    calls, risk = _Calls(), st.DeadlineRisk(600_000)
    risk.init(calls)
    polls = pd.DataFrame([(4_000 * k, k, 100 * k, 10_000, 90_000, 0) for k in range(60)], columns=["arrived_ms", "seq", "out_ms", "total_ms", "budget_ms", "future_ms"])
    frames_of = lambda df: iter([df.iloc[:40], df.iloc[40:]])
    assert not list(risk.handleInputRows((7,), frames_of(polls), None))
    assert calls.timers == [0] and calls.sent <= 8
    # the polls that the watermark has passed are judged at once, and the first one left has the next timer
    first = [r for f in risk.handleExpiredTimer((7,), _At(20_000), _At(20_000)) for r in f.itertuples(index=False, name=None)]
    assert not first and calls.timers == [0, 24_000]
    rest = [r for f in risk.handleExpiredTimer((7,), _At(10**9), _At(10**9)) for r in f.itertuples(index=False, name=None)]
    assert rest == plain_alerts(polls.assign(proc_id=7)) and len(rest) == 1
    assert calls.value is None and calls.sent <= 24
