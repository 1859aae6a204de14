"""Extension (the batch commands don't need it): drift as files change, and late events by window.

drift_stream() compares every micro-batch of changed files with the stored digests of the rules that cite them.
event_counts() counts events in windows with a watermark, so late rows within it are counted where they belong.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import checks


def drift_stream(changed: DataFrame, stored: DataFrame, citations: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """changed: a stream of (path, content); stored: (rule_id, digest); citations: (rule_id, path, lines)."""

    def batch(files: DataFrame, epoch: int) -> None:
        touched = citations.join(files.select("path").distinct(), "path", "left_semi").select("rule_id").distinct()
        # A rule that cites a file outside the batch as well can't be judged from the batch alone.
        outside = citations.join(files.select("path").distinct(), "path", "left_anti").select("rule_id").distinct()
        whole = touched.join(outside, "rule_id", "left_anti")
        now = checks.digests(citations.join(whole, "rule_id", "left_semi"), files)
        sink(checks.drift(stored.join(whole, "rule_id", "left_semi"), now), epoch)

    return changed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, time: str, key: str, window: str = "1 day", late: str = "10 days") -> DataFrame:
    """(window_start, key, n) counts, with rows up to `late` behind still counted."""
    w = events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), key, "n")
