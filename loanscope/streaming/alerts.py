"""Alerts on segments whose incident rate rises above the portfolio's.

Events arrive with an id, a time, a segment and a mark that tells incidents from the rest. They are counted in sliding event-time windows by
segment; every closed window is compared with the default rate that the portfolio shows for the segment, the baseline. A window raises an alert
when it holds enough events and its rate lies above the baseline by a number of standard errors and by a factor.

The same functions build the batch result: a stream whose rows all come before the watermark gives exactly the alerts of
``segment_alerts`` over the rows seen, for the windows that the watermark has closed (``closed_before``). Rows that come later than the
watermark allows are left out, and a second row with the id of an earlier one counts once.

State is one row per open window and segment, and one id per event within the watermark. The baseline is a small static table that
every micro-batch joins anew; Catalyst broadcasts it where it has measured it as small.

Defined results: events without a time or id, or of no segment, are left out; a segment that the portfolio does not hold is
compared with the rate of the whole portfolio; an empty portfolio has no baseline and raises no alert.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loanscope.schemas import TARGET


@dataclass(frozen=True)
class AlertRule:
    """Windows, lateness and thresholds of the alerts."""

    window: str = "24 hours"
    slide: str = "6 hours"
    lateness: str = "6 hours"
    least_events: int = 20
    factor: float = 1.1
    warning_errors: float = 1.0  # standard errors above the baseline
    critical_errors: float = 2.0


def baseline(credits: DataFrame, segment: str) -> DataFrame:
    """segment, base_rate: the default rate of each segment, and that of the whole portfolio under a null segment."""
    labelled = credits.filter(F.col(TARGET).isNotNull()).select(F.col(segment).alias("segment"), TARGET)
    return labelled.rollup("segment").agg(F.avg(TARGET).alias("base_rate"), F.grouping("segment").alias("whole")).filter(
        F.col("segment").isNotNull() | (F.col("whole") == 1)).select("segment", "base_rate")


def unique_events(events: DataFrame, rule: AlertRule) -> DataFrame:
    """Events that can be counted, each id once; with a watermark where the events are a stream."""
    usable = events.filter(F.col("event_id").isNotNull() & F.col("event_time").isNotNull() & F.col("segment").isNotNull())
    if events.isStreaming:
        return usable.withWatermark("event_time", rule.lateness).dropDuplicatesWithinWatermark(["event_id"])
    return usable.dropDuplicates(["event_id"])


def segment_windows(events: DataFrame, rule: AlertRule = AlertRule()) -> DataFrame:
    """segment, window_start, window_end, events, incidents of every sliding window."""
    counted = unique_events(events, rule).groupBy(F.window("event_time", rule.window, rule.slide), "segment").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("incident").alias("incidents"))
    return counted.select("segment", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "events", "incidents")


def segment_alerts(windows: DataFrame, base: DataFrame, rule: AlertRule = AlertRule()) -> DataFrame:
    """The windows that raise an alert, with rate, baseline, excess in standard errors, and level."""
    own = base.filter(F.col("segment").isNotNull())
    whole = base.filter(F.col("segment").isNull()).agg(F.max("base_rate").alias("whole_rate"))  # one row
    compared = windows.join(own, "segment", "left").crossJoin(F.broadcast(whole))
    rate, expected = F.col("incidents").cast("double") / F.col("events").cast("double"), F.coalesce("base_rate", "whole_rate")
    measured = compared.withColumn("rate", rate).withColumn("baseline", expected).withColumn("errors", excess(
        F.col("rate"), F.col("baseline"), F.col("events")))
    raised = measured.filter(
        (F.col("events") >= rule.least_events) & (F.col("rate") >= F.col("baseline") * rule.factor) & (F.col("errors") >= rule.warning_errors))
    level = F.when(F.col("errors") >= rule.critical_errors, "critical").otherwise("warning")
    return raised.select("segment", "window_start", "window_end", "events", "incidents", "rate", "baseline", "errors", level.alias("level"))


def excess(rate: Column, expected: Column, events: Column) -> Column:
    """How many standard errors of the expected rate lie between both; infinite where the expected rate allows no variation."""
    error = F.sqrt(expected * (1 - expected) / events.cast("double"))
    return F.when(error > 0, (rate - expected) / error).when(rate > expected, F.lit(float("inf"))).otherwise(F.lit(0.0))


def closed_before(windows: DataFrame, latest: Column, rule: AlertRule = AlertRule()) -> DataFrame:
    """The windows that a watermark ``rule.lateness`` behind the latest event time has closed."""
    return windows.filter(F.col("window_end") <= latest - F.expr(f"INTERVAL {rule.lateness}"))


def start_alerts(
    events: DataFrame, base: DataFrame, alerts_path: str, checkpoint: str, rule: AlertRule = AlertRule(), available_now: bool = False,
) -> StreamingQuery:
    """Append the alerts of each closed window once; a restart from the checkpoint neither loses nor repeats one."""
    alerts = segment_alerts(segment_windows(events, rule), base, rule)
    writer = alerts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", alerts_path)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
