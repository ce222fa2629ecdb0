"""Streams over several files give what a batch gives."""

from pyspark.sql import functions as F

from tidegauge.operators.aggregate import LIVE_KEY, partial_merge, sum_by
from tidegauge.operators.binning import split_over_bins
from tidegauge.operators.ingest import counted_opens
from tidegauge.plans import streams
from tidegauge.streaming import live


def test_partials_of_late_rows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/io_event.parquet").withColumn("fd", F.coalesce("fd", F.lit(0)))
    events.repartition(4).write.parquet(str(tmp_path / "in"))  # every file has rows of every time
    stream = live.event_stream(spark, str(tmp_path / "in"))
    folder = live.partial_rows(stream, LIVE_KEY)
    raw = spark.read.parquet(folder)
    assert raw.select("batch").distinct().count() == 4
    split = split_over_bins(events)
    want = sorted(map(str, sum_by(split, LIVE_KEY).collect()))
    assert raw.count() > len(want)
    assert sorted(map(str, live.merged_partials(spark, folder, LIVE_KEY).collect())) == want
    assert sorted(map(str, partial_merge(split, LIVE_KEY, 5).collect())) == want


def test_counts_and_handles(spark, tmp_path):
    rows = [(i % 3, i, 1 if i % 5 else -1) for i in range(60)]
    df = spark.createDataFrame(rows, "handle bigint, event_id bigint, delta int")
    for k in range(3):  # in order from file to file
        df.filter((F.col("event_id") >= 20 * k) & (F.col("event_id") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.event_stream(spark, str(tmp_path / "in"))
    got = sorted(map(tuple, live.counted_opens_stream(stream).collect()))
    assert got == sorted(map(tuple, counted_opens(df).collect()))
    assert {r["handle"]: r["n"] for r in live.running_counts(stream, ["handle"]).collect()} == {0: 20, 1: 20, 2: 20}


def test_small_files_share_a_batch(spark, sf_dir, tmp_path):
    """A batch is cut by bytes: many small files don't make many batches, and files above the size come one by one."""
    events = spark.read.parquet(f"{sf_dir}/io_event.parquet")
    events.repartition(6).write.parquet(str(tmp_path / "io_event.parquet"))
    got = {}
    for size in (live.BATCH_BYTES, 1):
        stream = live.event_stream(spark, str(tmp_path / "io_event.parquet"), bytes_per_trigger=size)
        folder = live.partial_rows(stream, ["category", "timeBin"])
        got[size] = (spark.read.parquet(folder).select("batch").distinct().count(), sorted(map(str, live.merged_partials(spark, folder, ["category", "timeBin"]).collect())))
    assert (got[live.BATCH_BYTES][0], got[1][0]) == (1, 6)
    assert got[live.BATCH_BYTES][1] == got[1][1]
    batches = []
    drained = live.drained
    try:
        live.drained = lambda *a, **k: batches.append(drained(*a, **k)) or batches[-1]
        n = sum(r["n"] for r in streams.stream_tumbling(spark, str(tmp_path)).collect())
    finally:
        live.drained = drained
    assert n == events.count()
    assert spark.read.parquet(batches[0]).select("batch").distinct().count() == 1
