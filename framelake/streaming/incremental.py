"""An extension: histograms and arrival counts kept up to date over a stream of events. Batch and stream share the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.histogram import histogram
from framelake.sources.pixels import placed


def running_histogram(events: DataFrame, bits: int = 4) -> DataFrame:
    """Streaming events to a histogram per clip; state is one row per clip and cell. Write in complete or update mode."""
    return histogram(placed(events), bits, ["clip_id"])


def frames_per_window(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Pixels per clip and time window with a watermark, so state is dropped once a window can't change."""
    px = events.withWatermark("ts", late)
    return px.groupBy(F.window("ts", width), (F.col("event_id") % 4).alias("clip_id")).agg(F.count(F.lit(1)).alias("pixels"))
