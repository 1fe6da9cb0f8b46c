"""Incremental scans over a stream of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _arrived(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One row a batch of each (hash, path), with the time of the batch that saw it first."""
    now = state.getCurrentProcessingTimeMs()
    first = state.get[0] if state.exists else now
    if not state.exists:
        state.update((first,))
    for b in batches:
        if len(b):
            yield b.iloc[:1].assign(first_seen=first, again=first != now)
            return


def scan_stream(files: DataFrame, scan: Callable[[DataFrame], DataFrame], findings_path: str, clean_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Scan each new file of a stream (repo, path, content), and those that come again until they are clean.

    Content hashes and paths are keys of a state that holds when each was first seen, so a batch looks up its own keys
    only. A key that comes again was clean unless the keys with findings name it, which stand beside the checkpoint by
    the time they were first seen; the lookup reads the times that it needs. So the work of a batch follows the batch,
    whatever was scanned before (with many keys name the RocksDB state store in the session).

    Findings and clean (hash, path) pairs are written by the batch's number. A batch that runs again after a failure
    has the same number, keys and times, and replaces what it wrote. Files that equal in hash and path within a batch are
    scanned once; late duplicates are met by the state like any others, so no watermark is needed. Where a batch holds
    several contents of a path, a finding of one keeps all of them from being clean. Null contents count as empty."""
    dirty_path = f"{checkpoint}-dirty"
    shape = {f.name: f.dataType.simpleString() for f in files.schema.fields}
    hashed = files.withColumn("hash", F.sha2(F.coalesce(F.col("content"), F.lit("")).cast("binary"), 256))
    out = ", ".join(f"`{n}` {t}" for n, t in shape.items()) + ", hash string, first_seen long, again boolean"
    seen = hashed.groupBy("hash", "path").applyInPandasWithState(_arrived, out, "first_seen long", "append", GroupStateTimeout.NoTimeout)

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        try:
            todo = rows.where("not again")
            times = [r[0] for r in rows.where("again").select("first_seen").distinct().limit(1001).collect()]
            if times and number:
                known = spark.read.option("basePath", dirty_path).schema("path string, hash string, first_seen long, batch long").parquet(dirty_path).where(F.col("batch") < number)
                # named times prune the folders before the join; of many, the join does
                known = known.where(F.col("first_seen").isin(times)) if len(times) <= 1000 else known
                todo = todo.unionByName(rows.where("again").join(known.select("path", "hash", "first_seen").distinct(), ["path", "hash", "first_seen"], "left_semi").select(todo.columns))
            found = scan(todo.drop("first_seen", "again"))
            found.write.mode("overwrite").parquet(f"{findings_path}/batch={number}")
            bad = spark.read.schema(found.schema).parquet(f"{findings_path}/batch={number}").select("repo", F.col("file").alias("path")).distinct()
            keys = todo.select("repo", "path", "hash", "first_seen")
            keys.join(bad, ["repo", "path"], "left_semi").select("path", "hash", "first_seen").distinct().write.mode("overwrite").partitionBy("first_seen").parquet(f"{dirty_path}/batch={number}")
            keys.join(bad, ["repo", "path"], "left_anti").select("hash", "path").distinct().write.mode("overwrite").parquet(f"{clean_path}/batch={number}")
        finally:
            rows.unpersist()

    writer = seen.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
