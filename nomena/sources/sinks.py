"""Sinks: JSON lines in row order, splits as folders, tables as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_jsonl(df: DataFrame, path: str, order: str = "sample_idx") -> None:
    """Files in name order hold the rows in order; the order column is not written. An existing path is an error."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, order).sortWithinPartitions(order).drop(order).write.json(path)


def save_splits(df: DataFrame, path: str) -> None:
    """One folder a split; splits without rows have none."""
    df.write.partitionBy("split").json(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small report as a Markdown table; more than `most` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
