"""New blocks as a stream: traces are flattened and logs decoded row by row, without state, so the batch operators run
unchanged; the creation closure grows by foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.base import base_transform
from ..operators.graph import create_closure, creation_edges
from ..operators.trace import flatten_traces


def stream_traces(traces: DataFrame) -> DataFrame:
    """A stream of (hash, blockNumber, timeStamp, trace_json) to flat, typed steps."""
    return base_transform(flatten_traces(traces))


def steps_per_window(steps: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Steps by call type in windows of block time, closed once late blocks are no longer waited for."""
    kind = F.coalesce("calltype", F.lit("EVENT")).alias("kind")
    return steps.withWatermark("timeStamp", late).groupBy(F.window("timeStamp", window), kind).agg(F.count("*").alias("n"))


def grow_contracts(steps: DataFrame, contracts_path: str, edges_path: str) -> DataStreamWriter:
    """Keeps the DApp's contracts up to date: each batch's creations join those of before, and the closure is taken anew.

    Batches are numbered; a batch that is run again overwrites its own folder, so nothing counts twice.
    """

    def grow(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        creation_edges(batch).write.mode("overwrite").parquet(f"{edges_path}/batch={number}")
        edges = spark.read.parquet(edges_path).select("from", "to")
        seeds = spark.read.parquet(f"{contracts_path}/seeds").select("address")
        create_closure(edges, seeds).write.mode("overwrite").parquet(f"{contracts_path}/closure")

    return steps.writeStream.foreachBatch(grow)
