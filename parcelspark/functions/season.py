"""Season calendar: two-week bins, bin centres, early-season weight."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@dataclass(frozen=True)
class Season:
    start: str = "2024-04-15"
    end: str = "2024-10-31"
    bin_days: int = 14

    @property
    def days(self) -> int:
        return (date.fromisoformat(self.end) - date.fromisoformat(self.start)).days

    @property
    def n_bins(self) -> int:
        return max(0, -(-self.days // self.bin_days))


def day_offset(day: Column, season: Season) -> Column:
    return F.datediff(day, F.lit(season.start).cast("date"))


def bin_index(day: Column, season: Season) -> Column:
    """Index of the bin with `start <= day < end`; null outside the season (its last day included)."""
    offset = day_offset(day, season)
    inside = (offset >= 0) & (offset < season.days)
    return F.when(inside, F.floor(offset / season.bin_days).cast("int"))


def bin_edges(index: Column, season: Season) -> tuple[Column, Column]:
    first = (index * season.bin_days).cast("int")
    last = F.least(first + season.bin_days, F.lit(season.days)).cast("int")
    start = F.lit(season.start).cast("date")
    return F.date_add(start, first), F.date_add(start, last)


def bin_center(index: Column, season: Season) -> Column:
    """Midpoint of a bin, floored to a date; the last bin may be shorter."""
    first, last = bin_edges(index, season)
    return F.date_add(first, F.floor(F.datediff(last, first) / 2).cast("int"))


def season_bins(spark: SparkSession, season: Season) -> DataFrame:
    """The bin calendar as a table."""
    index = F.col("id").cast("int")
    first, last = bin_edges(index, season)
    return spark.range(season.n_bins).select(
        index.alias("bin"),
        first.alias("bin_start"),
        last.alias("bin_end"),
        bin_center(index, season).alias("bin_center"),
    )


@udtf(returnType="bin int, bin_start date, bin_end date, bin_center date")
class SeasonBins:
    """The bin calendar as a table function: one row per bin of a season given by its dates and the bins' length."""

    def eval(self, start: date, end: date, bin_days: int):
        if start is None or end is None or not bin_days or bin_days < 1:
            return
        days = (end - start).days
        for index in range(max(0, -(-days // bin_days))):
            first, last = index * bin_days, min((index + 1) * bin_days, days)
            yield index, start + timedelta(first), start + timedelta(last), start + timedelta(first + (last - first) // 2)


def register_season_bins(spark: SparkSession, name: str = "season_bins") -> None:
    """Make the calendar callable from SQL: `SELECT ... FROM seasons s, LATERAL season_bins(s.start, s.end, 14) b`."""
    spark.udtf.register(name, SeasonBins)


def season_fraction(day: Column, season: Season) -> Column:
    return F.greatest(F.lit(0), day_offset(day, season)) / F.lit(float(season.days or 1))


def early_weight(day: Column, season: Season, urgency: float = 1.5, early: float = 0.3) -> Column:
    """Weight of an observation; days before the season start count as early."""
    return F.when(season_fraction(day, season) < early, F.lit(float(urgency))).otherwise(F.lit(1.0))
