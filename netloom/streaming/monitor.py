"""Availability by minute and window membership, over a stream of probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def availability_by_minute(probes: DataFrame, windows: DataFrame, late: str = "30 seconds") -> DataFrame:
    """(window, url, inside, probes, availability) of a stream of probes (at timestamp, url, ok).

    ``windows`` (start, end in seconds) are declared intervals, few enough to be broadcast to each
    batch. Probes that come later than the watermark are left out.
    """
    t = F.unix_micros("at") / 1e6
    spans = F.broadcast(windows.select("start", "end").distinct().agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    d = probes.withWatermark("at", late).join(spans).withColumn("inside", F.exists("spans", lambda w: t.between(w["start"], w["end"])))
    return d.groupBy(F.window("at", "1 minute"), "url", "inside").agg(F.count("*").alias("probes"), F.avg("ok").alias("availability"))
