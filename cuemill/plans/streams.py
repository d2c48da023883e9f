"""Queries: batch twins of the streaming jobs (the same code runs on streams in the tests)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuemill.operators.intervals import frame_spans
from cuemill.plans.intervals import union_sql
from cuemill.plans.registry import query
from cuemill.session import ensure_checkpoint_dir
from cuemill.sources.tables import cache_log, progress, speech
from cuemill.streaming import progress as st


def reports(spark, sf_dir):
    """Progress reports on a clock a hundred times faster, so that polls are seconds apart as in live use."""
    return progress(spark, sf_dir).select(
        "proc_id", "seq", F.floor(F.col("arrived_ms") / 100).alias("arrived_ms"), "out_ms", F.lit(600_000).cast("long").alias("total_ms"), (F.lit(90_000) + F.col("proc_id") % 7 * 20_000).alias("budget_ms"))


_STORE = "spark.sql.streaming.stateStore.providerClass"


@query("s1_deadline_risk")
def deadline_risk(spark, sf_dir):
    """The stream itself over the written reports, and its alerts as a table. A report far in the future, of a process
    that has no other, moves the watermark past all others."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/deadlines-{uuid.uuid4().hex}"
    rows = reports(spark, sf_dir)
    last = spark.createDataFrame([(-1, 0, 10**12, 0, 1, 1)], rows.schema)
    rows.unionByName(last).write.parquet(f"{base}/reports")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{base}/reports")
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        alerts = st.deadline_alerts(stream, delay="2 minutes").writeStream.outputMode("append").format("parquet").option("path", f"{base}/alerts")
        alerts.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema(st.ALERT).parquet(f"{base}/alerts")


@query("s4_merged_log", "cache_log", """
select cue_ix, target, seq, translation from (select *, row_number() over (partition by cue_ix, target order by seq desc) as r from cache_log) where r=1 and is_valid""")
def merged_log(spark, sf_dir):
    """The log in four batches by its order, folded one after another; the first one comes twice, as after a failure."""
    log = cache_log(spark, sf_dir)
    last = log.agg(F.max("seq")).first()[0] or 0
    snapshot = f"{ensure_checkpoint_dir(spark).rstrip('/')}/merged-log-{uuid.uuid4().hex}"
    merge = st.merge_log(spark, snapshot, ["cue_ix", "target"], buckets=16)
    for epoch in (0, 0, 1, 2, 3):
        merge(log.filter(F.floor(F.col("seq") * 4 / (last + 1)) == epoch), epoch)
    return st.current_log(spark, snapshot, log.schema).select("cue_ix", "target", "seq", "translation")


def percents(spark, sf_dir):
    return progress(spark, sf_dir).select(
        "proc_id", "seq", F.floor(F.col("out_ms") / 500).alias("percent"), (F.col("arrived_ms") + 1).alias("elapsed_ms"), ((F.col("proc_id") + 1) * 1_000_000_000).alias("input_bytes"))


@query("s2_progress_state", "progress", """
p as (select proc_id, cast(out_ms//500 as bigint) as percent, arrived_ms+1 as elapsed, (proc_id+1)*1000000000 as input_bytes from progress where out_ms//500 between 0 and 100),
b as (select *, row_number() over (partition by proc_id order by percent desc, elapsed) as r, count(*) over (partition by proc_id) as reports from p)
select proc_id, reports, percent, round(input_bytes*percent/100/(greatest(1,elapsed)/1000)/1048576,3) as mib_per_s from b where r=1""")
def progress_state(spark, sf_dir):
    return st.progress_state(percents(spark, sf_dir))


def frames(spark, sf_dir):
    first, last = F.floor(F.col("start_ms") / 10), F.floor(F.col("end_ms") / 10)
    return speech(spark, sf_dir).filter(last > first).select("media_id", F.explode(F.sequence(first, last - 1)).alias("frame"))


@query("s5_closed_intervals", "speech", """
f as (select distinct media_id, unnest(range(start_ms//10, end_ms//10)) as start_ms from speech where end_ms//10>start_ms//10),
g as (select media_id, start_ms, start_ms+1 as end_ms from f),
""" + union_sql("u", "g", bridge=15) + """
select media_id, start_ms*10 as start_ms, end_ms*10 as end_ms from u where end_ms-start_ms>=10""")
def closed_intervals(spark, sf_dir):
    return st.closed_intervals(frame_spans(speech(spark, sf_dir), ["media_id"]), until="until")
