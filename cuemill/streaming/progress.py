"""Live reports: deadline risk, monotone progress, speech intervals, append logs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed values, in milliseconds.
FRESH_GAP_MS = 5_000
WARM_UP_MS = 30_000
LOOK_BACK_MS = (10_000, 25_000)
RESERVE_MS = 20_000
RISKY_REPORTS = 3
VALID_REPORTS = 3

ALERT = t.StructType([
    t.StructField("proc_id", t.LongType()), t.StructField("arrived_ms", t.LongType()), t.StructField("out_ms", t.LongType()), t.StructField("eta_ms", t.LongType()),
    t.StructField("remaining_ms", t.LongType())])
_SCALARS = t.StructType([
    t.StructField("last_poll", t.LongType()), t.StructField("last_out", t.LongType()), t.StructField("valid", t.IntegerType()), t.StructField("risk", t.IntegerType()),
    t.StructField("dead", t.BooleanType()), t.StructField("alerted", t.BooleanType()), t.StructField("samples", t.BinaryType())])
# A value of a state is a message whose fields are checked and told apart one by one, so lists of numbers are bytes: the
# samples behind the scalars, and the reports of one batch of rows.
_REPORTS = t.StructType([t.StructField("rows", t.BinaryType())])
_REPORT = ["arrived_ms", "seq", "out_ms", "total_ms", "budget_ms", "future_ms"]
FRESH = (-1, -1, 0, 0, False, False)


def observe(scalars: tuple, samples: list, now: int, reports: list, total_ms: int, budget_ms: int, future_ms: int = 0) -> tuple[tuple, list, tuple | None]:
    """One poll of one process: the new state and an alert, if the deadline is at risk for the third time.

    Reports of one poll count once. A gap between polls clears the evidence; output that goes back ends the process's
    evidence for good. `future_ms` is media that is still to come after `total_ms` and takes its time as well.
    """
    last_poll, last_out, valid, risk, dead, alerted = scalars
    if last_poll >= 0 and now - last_poll > FRESH_GAP_MS:
        samples, valid, risk = [], 0, 0
    out = reports[-1]
    if len(reports) > 1:
        risk = 0
    if out is None or out < 0 or out > total_ms + 1_000 or future_ms < 0 or out == last_out:
        return (now, last_out, valid, 0, dead, alerted), samples, None
    if out < last_out:
        return (now, last_out, 0, 0, True, alerted), [], None
    if dead or out == 0:
        return (now, out, valid, risk, dead, alerted), samples, None
    valid += 1
    samples = [s for s in [*samples, (now, out)] if now - s[0] <= LOOK_BACK_MS[1]]
    if out >= total_ms:
        return (now, out, valid, 0, dead, alerted), samples, None
    remaining = budget_ms - now
    back = next((s for s in reversed(samples) if LOOK_BACK_MS[0] <= now - s[0]), None)
    if alerted or valid < VALID_REPORTS:
        return (now, out, valid, risk, dead, alerted), samples, None
    if remaining <= 0 or now < WARM_UP_MS or back is None or out <= back[1]:
        return (now, out, valid, 0, dead, alerted), samples, None
    eta = int((total_ms - out + future_ms) * (now - back[0]) / (out - back[1])) + RESERVE_MS
    risk = risk + 1 if eta > remaining else 0
    alert = (now, out, eta, remaining) if risk >= RISKY_REPORTS else None
    return (now, out, valid, risk, dead, alerted or alert is not None), samples, alert


def _packed(rows) -> bytes:
    return np.asarray(rows, np.int64).tobytes()


def _unpacked(packed: bytes, width: int) -> list[tuple]:
    return [*map(tuple, np.frombuffer(packed, np.int64).reshape(-1, width).tolist())]


class DeadlineRisk(StatefulProcessor):
    """State of one process: scalars with the samples of the last 25 s, and the polls that the watermark has not passed.

    A poll is judged once the watermark has passed it, when no more of its reports can come, so batches of any cut give
    the same alerts. A process without polls for `expire_ms` is forgotten. Each call to a state or a timer is a message
    between processes, so their number is by batch and process, not by poll.
    """

    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scalars = handle.getValueState("scalars", _SCALARS)
        self.open = handle.getListState("open", _REPORTS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = (self.scalars.get() or FRESH)[0]
        new = []
        for frame in rows:
            reports = frame[_REPORT].astype("int64").to_numpy()
            new.append(reports[reports[:, 0] > seen])
        new = [reports for reports in new if len(reports)]
        if new:
            self.open.appendList([(_packed(reports),) for reports in new])
            # one timer stands for all polls of the batch: when it expires, all that are passed are judged, and the first one left gets the next
            self.handle.registerTimer(int(min(reports[:, 0].min() for reports in new)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        held = sorted(r for value in self.open.get() for r in _unpacked(value[0], len(_REPORT)))
        kept = self.scalars.get()
        scalars, samples = (tuple(kept[:6]), _unpacked(kept[6], 2)) if kept else (FRESH, [])
        alerts = []
        for now, poll in groupby((r for r in held if r[0] <= passed), key=lambda r: r[0]):
            poll = list(poll)
            if scalars[0] >= 0 and now - scalars[0] > self.expire_ms:  # forgotten, whatever the batches
                scalars, samples = FRESH, []
            scalars, samples, alert = observe(scalars, samples, now, [r[2] for r in poll], *poll[-1][3:])
            if alert:
                alerts.append((int(key[0]), *alert))
        later = [r for r in held if r[0] > passed]
        if not later and passed >= scalars[0] + self.expire_ms:
            self.scalars.clear()
            self.open.clear()
        else:
            self.scalars.update((*scalars, _packed(samples)))
            if later:
                self.open.put([(_packed(later),)])
            else:
                self.open.clear()
            self.handle.registerTimer(later[0][0] if later else scalars[0] + self.expire_ms)
        return iter([pd.DataFrame(alerts, columns=ALERT.names)] if alerts else ())

    def close(self) -> None:
        pass


def deadline_alerts(reports: DataFrame, delay: str = "10 seconds", expire_ms: int = 3_600_000) -> DataFrame:
    """One alert per process whose deadline stays at risk for three reports, from a stream in event time.

    `reports(proc_id, seq, arrived_ms, out_ms, total_ms, budget_ms [, future_ms])`, which may come out of order by up to
    `delay`; later ones are dropped. Needs the RocksDB state store.
    """
    future = F.col("future_ms") if "future_ms" in reports.columns else F.lit(0).cast("long")
    timed = reports.withColumns({"future_ms": future, "at": F.timestamp_millis("arrived_ms")}).withWatermark("at", delay)
    return timed.groupBy("proc_id").transformWithStateInPandas(
        statefulProcessor=DeadlineRisk(expire_ms), outputStructType=ALERT, outputMode="Append", timeMode="EventTime")


def progress_state(reports: DataFrame, key: str = "proc_id") -> DataFrame:
    """Highest valid percentage of every process and its estimated rate (update mode in streams)."""
    percent = F.when(F.col("percent").between(0, 100), F.col("percent"))
    best = F.max(F.struct(percent.alias("p"), (-F.col("elapsed_ms")).alias("e")))
    folded = reports.filter(percent.isNotNull()).groupBy(key).agg(best.alias("b"), F.max("input_bytes").alias("input_bytes"), F.count(F.lit(1)).alias("reports"))
    rate = F.col("input_bytes") * F.col("b.p") / 100 / (F.greatest(F.lit(1), -F.col("b.e")) / 1_000) / 1_048_576
    return folded.select(key, "reports", F.col("b.p").alias("percent"), F.round(rate, 3).alias("mib_per_s"))


def latest_stage(events: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Latest state per candidate and stage of an event stream (update mode)."""
    return events.groupBy(key, "stage").agg(F.max(F.struct("seq", "state", "reason")).alias("s")).select(key, "stage", "s.seq", "s.state", "s.reason")


def closed_intervals(frames: DataFrame, key: str = "media_id", watermark: str = "10 seconds", until: str | None = None) -> DataFrame:
    """Active 10 ms frames to intervals as they close.

    Frames are event times; a gap of 161 ms between frame starts closes an interval, which equals a
    gap of more than 150 ms between frames. Pieces under 100 ms are dropped.

    A row is one frame, or with `until` the frames from `frame` up to it: its session lasts until 161 ms after the start
    of its last frame, and its event time is that of its first.
    """
    start = F.timestamp_millis(F.col("frame") * 10)
    after = F.col(until) if until else F.col("frame") + 1
    timed = frames.select(key, start.alias("at"), (after * 10).alias("end_ms"), ((after - 1 - F.col("frame")) * 10 + 161).alias("gap_ms"))
    if frames.isStreaming:
        timed = timed.withWatermark("at", watermark)
    gap = F.make_interval(secs=(F.col("gap_ms") / 1_000).cast("decimal(18,6)")) if until else "161 milliseconds"
    spans = timed.groupBy(key, F.session_window("at", gap).alias("w")).agg(F.max("end_ms").alias("end_ms"))
    return spans.select(key, F.unix_millis("w.start").alias("start_ms"), "end_ms").filter("end_ms - start_ms >= 100")


# The merged log -------------------------------------------------------------------------------


def _children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system that Spark reaches, none if it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [entry.getPath().getName() for entry in system.listStatus(path)] if system.exists(path) else []


def _generations(spark: SparkSession, snapshot: str) -> list[int]:
    """Epochs whose marker was written to its end, in order."""
    epochs = sorted(int(name.split("=")[1]) for name in _children(spark, f"{snapshot}/markers") if name.startswith("epoch="))
    return [e for e in epochs if "_SUCCESS" in _children(spark, f"{snapshot}/markers/epoch={e}")]


def _places(spark: SparkSession, snapshot: str, epoch: int | None = None) -> dict[int, int]:
    """The epoch that wrote each bucket's current rows, as of a generation (the last one)."""
    known = [e for e in _generations(spark, snapshot) if epoch is None or e <= epoch]
    if not known:
        return {}
    marker = spark.read.schema("bucket int, written long").parquet(f"{snapshot}/markers/epoch={known[-1]}")
    return {r["bucket"]: r["written"] for r in marker.collect()}


def merge_log(spark: SparkSession, snapshot: str, keys, order: str = "seq", buckets: int = 64):
    """foreachBatch body: fold a batch of log records into a keyed Parquet snapshot.

    The snapshot holds the last record of every key, valid or not, in `buckets` by the hash of the key. A batch rewrites
    the buckets of its own keys only, beside those it replaces, and writes its marker last: a row for each bucket that
    names the epoch that wrote it. What a lost executor or driver left without a marker is not read and is written over
    when the batch comes again; a batch whose marker stands changes nothing. An empty batch writes only the marker.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        if epoch in _generations(spark, snapshot):
            return
        places = _places(spark, snapshot, epoch - 1)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        rows = batch.withColumn("bucket", bucket)
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most `buckets`
        if touched:
            old = [f"{snapshot}/rows/epoch={places[b]}/bucket={b}" for b in touched if b in places]
            if old:
                rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("bucket", bucket))
            kept = [c for c in batch.columns if c not in keys]
            last = rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*kept), order).alias("r")).select("bucket", *keys, "r.*")
            last.write.mode("overwrite").partitionBy("bucket").parquet(f"{snapshot}/rows/epoch={epoch}")
        marker = spark.createDataFrame(sorted((places | dict.fromkeys(touched, epoch)).items()), "bucket int, written long")
        marker.coalesce(1).write.mode("overwrite").parquet(f"{snapshot}/markers/epoch={epoch}")

    return merge


def current_log(spark: SparkSession, snapshot: str, schema, epoch: int | None = None) -> DataFrame:
    """Valid last records of a snapshot, as of a generation (the last one); none before the first."""
    paths = [f"{snapshot}/rows/epoch={written}/bucket={bucket}" for bucket, written in _places(spark, snapshot, epoch).items()]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.filter("is_valid")


def drop_generations(spark: SparkSession, snapshot: str, keep: int = 2) -> list[int]:
    """Removes what only generations before the last `keep` read; returns the epochs whose rows went."""
    done = _generations(spark, snapshot)
    last = done[-keep:]
    used = {written for e in last for written in _places(spark, snapshot, e).values()}
    jvm, gone = spark._jvm.org.apache.hadoop.fs, []
    for e in done:
        for folder, stale in ((f"{snapshot}/markers/epoch={e}", e not in last), (f"{snapshot}/rows/epoch={e}", e not in used and e < last[0])):
            path = jvm.Path(folder)
            if stale and path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True) and "/rows/" in folder:
                gone.append(e)
    return gone
