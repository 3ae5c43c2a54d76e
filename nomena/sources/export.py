"""An export that can be taken up again: ordered JSON lines in parts by ranges of a key, each written once, a manifest last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_ranges(d: DataFrame, path: str, order: str, rows: int = 100_000) -> dict:
    """Writes d as JSON lines under path, a part for every `rows` values of the whole-number column `order`, in order inside and by name; returns the manifest.

    A part is a folder range=FROM whose _SUCCESS file says that it is whole. Parts that are whole are left as they are, so a run that was stopped goes on with the rest and the bytes are those of one run; a part's rows are
    sorted in one task, at most `rows` of them if the key is unique. The manifest (parts, rows, range) is written when all parts are there. The same d must be given again.
    """
    spark = d.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = at("").getFileSystem(conf)
    begin = F.floor(F.col(order) / rows).cast("long") * rows
    counts = {r["b"]: r["count"] for r in d.groupBy(begin.alias("b")).count().collect()}  # a row for each part
    name = lambda b: f"range={b:019d}"
    left = [b for b in sorted(counts) if not fs.exists(at(f"{name(b)}/_SUCCESS"))]
    for i in range(0, len(left), 64):  # some parts at a time: what a stopped run loses is one such set
        some = left[i : i + 64]
        part = d.filter(begin.isin(some)).withColumn("range", F.format_string("%019d", begin))
        part.repartition(len(some), "range").sortWithinPartitions("range", order).write.mode("overwrite").partitionBy("range").json(f"{path}/_work")
        for b in some:
            files = sorted(s.getPath().getName() for s in fs.listStatus(at(f"_work/{name(b)}")))
            fs.delete(at(name(b)), True)
            fs.mkdirs(at(name(b)))
            for n, f in enumerate(files):  # one, but where the writer is told to cut files by rows
                fs.rename(at(f"_work/{name(b)}/{f}"), at(f"{name(b)}/part-{n:05d}.json"))
            fs.create(at(f"{name(b)}/_SUCCESS"), True).close()
        fs.delete(at("_work"), True)
    manifest = {"order": order, "rows_per_part": rows, "parts": [{"range": b, "rows": counts[b]} for b in sorted(counts)], "rows": sum(counts.values())}
    out = fs.create(at("manifest.json"), True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return manifest
