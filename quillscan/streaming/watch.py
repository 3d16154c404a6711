"""An extension: the same plan over a stream of files, and the trend of scores by window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillscan.operators import match, score
from quillscan.operators.rules import Rule
from quillscan.sources.files import symbols


def watch(stream: DataFrame, rules: Sequence[Rule], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Analyse each batch of a stream of files (path, content, language) and write its file results to out/batch=number.

    A batch that runs again takes its own place.
    """

    def batch(files: DataFrame, number: int) -> None:
        found = match.detect(files, rules, symbols=symbols(files))
        score.file_results(files, found).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def trend(events: DataFrame, ts: str = "ts", value: str = "value", every: str = "10 minutes", late: str | None = "10 minutes") -> DataFrame:
    """(window_start, n, mean) by tumbling window; with a watermark on streams."""
    rows = events.withWatermark(ts, late) if events.isStreaming and late else events
    return rows.groupBy(F.window(ts, every).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), "n", "mean")
