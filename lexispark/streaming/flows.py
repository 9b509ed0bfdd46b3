"""Streaming flows over files and events; state and progress stay in the checkpoint folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def log_lines(spark: SparkSession, folder: str, keep: str | None = None, drop: str | None = None) -> DataFrame:
    """Lines of the text files that arrive in ``folder``, by a keyword to keep and one to drop."""
    lines = spark.readStream.text(folder).withColumnRenamed("value", "line")
    if keep:
        lines = lines.where(F.lower("line").contains(keep.lower()))
    return lines.where(~F.lower("line").contains(drop.lower())) if drop else lines


def last_opened(events: DataFrame, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Latest time of each key (complete or update mode)."""
    return events.groupBy(key).agg(F.max(ts).alias(ts))


def upload_states(messages: DataFrame) -> DataFrame:
    """Upload protocol of each client: START (with a size), BIN chunks, then DONE or ERROR.

    Columns client, seq, kind, size; a row a client and batch with its state and bytes. Bytes beyond
    the announced size, or a chunk without a start, end in ERROR until the next START. A batch's
    messages of a client are put in order by seq; those of earlier batches must come first.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, want, got = state.get if state.exists else ("IDLE", 0, 0)
        for m in pd.concat(list(frames)).sort_values("seq").itertuples():  # one client's batch
            if m.kind == "START":
                phase, want, got = ("DONE" if m.size == 0 else "RECEIVING"), int(m.size), 0
            elif m.kind == "BIN" and phase == "RECEIVING" and got + m.size <= want:
                got += int(m.size)
                phase = "DONE" if got == want else phase
            else:
                phase = "ERROR"
        state.update((phase, want, got))
        yield pd.DataFrame({"client": [key[0]], "state": [phase], "expected": [want], "received": [got]})

    return messages.groupBy("client").applyInPandasWithState(advance, "client string, state string, expected long, received long", "phase string, want long, got long", "update", GroupStateTimeout.NoTimeout)


def refresh(stream: DataFrame, path: str, checkpoint: str, key: str = "path") -> StreamingQuery:
    """Keeps the newest row (by mtime) of each key in the table at ``path``, which is left alone when nothing changes."""
    from ..sources.files import write_if_changed

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            batch = batch.unionByName(spark.read.parquet(path))
        rest = [c for c in batch.columns if c != key]
        newest = batch.groupBy(key).agg(F.max(F.struct(F.col("mtime").alias("__m"), *rest)).alias("r"))
        write_if_changed(newest.select(key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(batch.columns), path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
