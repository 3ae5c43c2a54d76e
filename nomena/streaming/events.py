"""Streams: the place of each request among equal ones, and votes in windows of time. Each has the same result as its batch query, whatever the micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.storage import shared_dir


def read_events(spark: SparkSession, folder: str, only: str = "*.parquet", files_at_once: int = 1) -> DataFrame:
    """A stream over the files of a folder whose names fit `only`, some at a time, in the order of their times."""
    schema = spark.read.option("pathGlobFilter", only).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", only).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def occurrences(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, order, occ): of each event the number of events with its key before it; a count for each key is the state.

    Events of one micro-batch are numbered by `order`, those of later ones go on. Equal to the batch query if no micro-batch holds an event that belongs before one of an earlier micro-batch; an event that comes late is numbered last.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(values: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        ids = np.sort(np.concatenate([b[order].to_numpy() for b in batches]))  # of one key in one micro-batch
        state.update((before + len(ids),))
        out = pd.DataFrame({c: [v] * len(ids) for c, v in zip(key, values, strict=True)})
        yield out.assign(**{order: ids, "occ": np.arange(before, before + len(ids))})

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*key, order]) + ", occ long"
    return events.select(*key, order).groupBy(*key).applyInPandasWithState(run, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def votes(events: DataFrame, value: str, time: str = "ts", length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, value, n): how often each value comes in each window of time. A window is given out once the watermark, the latest time less `late`, has passed it; what comes later than that is left out."""
    d = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, length).alias("w"), value).agg(F.count("*").alias("n"))
    return d.select(F.col("w.start").alias("start"), value, "n")


def collected(stream: DataFrame, name: str) -> DataFrame:
    """All that the stream gives out over what its source holds now, as a table of the shared folder. Run again under the same name it goes on where it was; state and progress lie beside the table."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{name}"
    q = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/progress").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
