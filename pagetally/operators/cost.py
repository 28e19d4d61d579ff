"""Throughput and cost arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOURS = 730  # of a month


def per_thousand(rate: Column, pages_per_minute: Column) -> Column:
    """Price of 1,000 pages on a machine at an hourly rate."""
    return rate / (pages_per_minute * 60) * 1000


def monthly_capacity(pages_per_minute: Column) -> Column:
    return pages_per_minute * 60 * HOURS


def in_series(a: Column, b: Column) -> Column:
    """Pages a minute of two engines one after the other."""
    return 1 / (1 / a + 1 / b)


def batch_price(rate: Column, pages_per_minute: Column, pages: Column, start_minutes: float = 10) -> Column:
    """Price of 1,000 pages of a batch that pays for the start."""
    return (pages / (pages_per_minute * 60) + start_minutes / 60) * rate / pages * 1000


def break_even(configurations: DataFrame, prices: DataFrame, services: Sequence[str], monthly: float = 3285.0) -> DataFrame:
    """(configuration, one column for each service): pages a month from which an own machine is cheaper, null
    above its capacity. configurations: configuration, capacity; prices: service, price (for 1,000 pages)."""
    known = {r.service: r.price for r in prices.where(F.col("service").isin(*services)).collect()}  # a row for each service
    at = lambda s: F.round(F.lit(monthly) / F.lit(known.get(s)).cast("double") * 1000)
    return configurations.select("configuration", *[F.when(at(s) <= F.col("capacity"), at(s)).alias(s) for s in services])


def run_cost(timing: DataFrame, run: str = "run") -> DataFrame:
    """(run, pages, cost): errors are billed as logged."""
    return timing.groupBy(run).agg(F.count_distinct("page").alias("pages"), F.sum("cost_usd").alias("cost"))
