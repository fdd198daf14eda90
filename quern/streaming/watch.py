"""Streams: change feeds into the reference ledger, and file watching.

The file source reports no deletions, so a watched root still needs the batch
delta from time to time; every micro-batch is applied once by its id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.references import ReferenceLedger, existence_deltas, reference_deltas


def watch(spark: SparkSession, root: str, build: Callable[[DataFrame, int], None], checkpoint: str, every: str = "500 milliseconds"):
    """Run `build` on each burst of new files below root."""
    stream = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(root)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(build).start()


def rebuild_on_change(root: str, rebuild: Callable[[], object], stop: Callable[[], bool], quiet: float = 0.5, poll: float = 0.1) -> int:
    """Call `rebuild` once after each burst of changes below root, deletions
    too, when nothing has changed for `quiet` seconds; returns how often.  The
    listing is of names, sizes and times only: what has changed the build
    finds out by its own delta."""
    import os
    import time

    def seen() -> dict[str, tuple[int, int]]:
        out = {}
        for folder, _, names in os.walk(root):
            for n in names:
                try:
                    st = os.stat(os.path.join(folder, n))
                except FileNotFoundError:
                    continue
                out[os.path.join(folder, n)] = st.st_mtime_ns, st.st_size
        return out

    known = done = seen()
    last, built = None, 0
    while not stop():
        time.sleep(poll)
        now = seen()
        if now != known:
            known, last = now, time.monotonic()
        elif last is not None and time.monotonic() - last >= quiet:
            last = None
            if known != done:
                rebuild()
                built, done = built + 1, known
    return built


def ledger_stream(parents: DataFrame | None, children: DataFrame | None, ledger: ReferenceLedger, checkpoint: str):
    """Fold a stream of parent or child rows into the ledger; restarted
    batches have the same id and are not counted twice."""
    name, stream = ("parents", parents) if parents is not None else ("children", children)

    def fold(batch: DataFrame, n: int) -> None:
        ledger.apply(f"{name}-{n}", existence_deltas(batch) if name == "parents" else reference_deltas(batch))

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(fold).start()


def event_windows(events: DataFrame, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Events per type and window (an extension; works on streams and tables)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
