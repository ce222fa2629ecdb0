"""The live aggregation as Structured Streaming jobs.

Late rows are never dropped: a micro-batch adds partial rows for any bin, and readers sum the partial rows of a key.
Every micro-batch writes its own folder, so a batch that is run again replaces its output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.functions.exprs import HOUR_NS
from tidegauge.functions.shared import shared_path
from tidegauge.operators.aggregate import sum_by
from tidegauge.operators.binning import split_over_bins
from tidegauge.schema import MEASURES


#: Stored bytes of a micro-batch over many files: a batch costs seconds of its own (state of every partition, log, output).
BATCH_BYTES = 256 << 20


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1, bytes_per_trigger: int | None = None) -> DataFrame:
    """Stream of the Parquet files at ``path`` (a file, a folder or a pattern) in their own schema.

    With ``bytes_per_trigger`` a micro-batch takes files up to that size, one at least, in place of a number of them.
    """
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    if not any(c in path for c in "*?[{"):  # a plain path must be a folder; a pattern that only it fits may be a file
        path = f"{folder}/[{name[0]}]{name[1:]}"
    limit = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger)
    return spark.readStream.schema(schema).option(*limit).parquet(path)


def drained(stream: DataFrame, each: Callable[[DataFrame], DataFrame], name: str, mode: str = "append") -> str:
    """Run the stream over all data there is now; batch n of ``each``'s result goes to ``<folder>/batch=n``. Returns the folder."""
    spark = stream.sparkSession
    base = f"{shared_path(spark)}/{name}-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(batch: DataFrame, n: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return out


def partial_rows(stream: DataFrame, keys: Sequence[str], bin_ns: int = HOUR_NS, measures: Sequence[str] = MEASURES) -> str:
    """Folder of the partial aggregates that the micro-batches emit: sums per key within each batch."""
    return drained(split_over_bins(stream, bin_ns), lambda b: sum_by(b, keys, measures), "partials")


def merged_partials(spark: SparkSession, folder: str, keys: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Final sums of the partial rows in a folder."""
    return sum_by(spark.read.parquet(folder).drop("batch"), keys, measures)


def running_counts(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per key, kept in the state store; every batch updates the keys that it touches and the last value counts."""
    counts = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    folder = drained(counts, lambda b: b, "counts", mode="update")
    return stream.sparkSession.read.parquet(folder).groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def _opens(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count = state.get[0] if state.exists else 0
    rows = pd.concat(list(frames)).sort_values("event_id", kind="stable")
    totals = rows["delta"].cumsum() + count
    state.update((int(totals.iloc[-1]),))
    hit = rows[(rows["delta"] == 1) & (totals == 1)]
    yield pd.DataFrame({"handle": [key[0]] * len(hit), "event_id": hit["event_id"].to_numpy()})


def counted_opens_stream(stream: DataFrame) -> DataFrame:
    """``(handle, event_id)`` of the opens that raise a handle's count to 1; the counts live in the state store.

    Events of a handle must arrive in order from batch to batch; within a batch they are sorted.
    """
    out = stream.groupBy("handle").applyInPandasWithState(
        _opens, "handle bigint, event_id bigint", "n bigint", "append", GroupStateTimeout.NoTimeout
    )
    folder = drained(out, lambda b: b, "opens")
    return stream.sparkSession.read.parquet(folder).drop("batch")
