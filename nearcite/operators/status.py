"""State of the refresh jobs from their run log."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds in days.
COOLDOWN_DAYS, AGING_DAYS, STALE_DAYS = 7, 60, 90
IN_FLIGHT = ("PENDING", "RUNNING")

_DAY = 86_400_000_000
_SECOND = 1_000_000


def job_states(runs: DataFrame) -> DataFrame:
    """``(job_id, last, last_success_time)`` from ``(job_id, run_id, run_time timestamp, state, error)``.

    Latest run and latest success are maxima, so a job with most of the runs combines early, and a stream of runs
    keeps no more than these of a job.
    """
    latest = F.max(F.struct("run_time", "run_id", "state", "error"))
    success = F.max(F.when(F.col("state") == "SUCCEEDED", F.col("run_time")))
    return runs.groupBy("job_id").agg(latest.alias("last"), success.alias("last_success_time"))


def refresh_status(runs: DataFrame, now: datetime | Column, configured: Column | bool = True) -> DataFrame:
    """One row per job from ``(job_id, run_id, run_time timestamp, state, error)``.

    ``now`` is a timestamp; a naive datetime counts as UTC.
    """
    return status_of(job_states(runs), now, configured)


def status_of(per_job: DataFrame, now: datetime | Column, configured: Column | bool = True) -> DataFrame:
    """The same from the states of the jobs."""
    if isinstance(now, datetime):
        utc = now.replace(tzinfo=timezone.utc) if now.tzinfo is None else now
        now = F.to_timestamp(F.lit(utc.isoformat()))
    now_us = F.unix_micros(now)
    days = F.floor((now_us - F.unix_micros("last_run_time")) / _DAY)
    status = per_job.select(
        "job_id",
        F.col("last.run_time").alias("last_run_time"),
        F.col("last.state").alias("last_state"),
        F.col("last.error").alias("last_error"),
        F.col("last.run_id").alias("last_run_id"),
        "last_success_time",
    ).withColumn("days_since", days)
    return (
        status.withColumn("freshness", freshness(F.col("days_since")))
        .withColumn("refreshed", days_text(F.col("days_since")))
        .withColumn("cooldown_days", cooldown_days(F.col("last_success_time"), now_us))
        .withColumn("in_flight", F.coalesce(F.col("last_state").isin(*IN_FLIGHT), F.lit(False)))
        .withColumn("failed", F.coalesce(F.col("last_state") != "SUCCEEDED", F.lit(False)))
        .withColumn(
            "can_trigger",
            (configured if isinstance(configured, Column) else F.lit(configured))
            & ~F.col("in_flight")
            & (F.col("cooldown_days") == 0),
        )
    )


def freshness(days: Column) -> Column:
    return F.when(days <= AGING_DAYS, "current").when(days <= STALE_DAYS, "aging").when(days.isNotNull(), "stale")


def days_text(days: Column) -> Column:
    return (
        F.when(days == 0, "today")
        .when(days == 1, "yesterday")
        .otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    )


def cooldown_days(success: Column, now_us: Column) -> Column:
    """Whole days left of the cooldown, started days counting whole; 0 without a success.

    A rest below one second does not start a day.
    """
    left = F.lit(COOLDOWN_DAYS * _DAY) - (now_us - F.unix_micros(success))
    whole = F.floor(left / _DAY)
    started = (left - whole * _DAY) >= _SECOND
    return F.when(success.isNull(), 0).otherwise(F.greatest(F.lit(0), whole + F.when(started, 1).otherwise(0))).cast("int")
