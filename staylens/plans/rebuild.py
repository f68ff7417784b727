"""Entry 1: the batch rebuild (scan -> clean -> windows -> facts -> funnel -> engine).

``Rebuild`` builds each step on first use, so a caller that needs only the
funnel never plans the engine.  Steps whose outputs are published and read
again downstream (windows, summary, funnel) are written once to the shared
checkpoint folder; the engine then plans over small scans.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from staylens.operators import clean, engine as E, facts, funnel as FN, periods as P, summary as S
from staylens.session import cut_lineage
from staylens.sources import driver_tables as T, feeds


@dataclass
class Sources:
    latest: DataFrame
    previous: DataFrame | None
    master: DataFrame
    performance: DataFrame
    bookings: DataFrame  # raw rows
    internal_parity: DataFrame  # raw rows
    ota_parity: DataFrame  # wide sheet


def driver_sources(spark: SparkSession, sf_dir: str) -> Sources:
    """The driver's tables mapped onto the demand model."""
    return Sources(
        latest=T.demand_latest(spark, sf_dir),
        previous=T.demand_previous(spark, sf_dir),
        master=T.hotel_master(spark, sf_dir),
        performance=T.hotel_performance(spark, sf_dir),
        bookings=T.booking_rows(spark, sf_dir),
        internal_parity=T.internal_parity_rows(spark, sf_dir),
        ota_parity=T.ota_parity_wide(spark, sf_dir),
    )


class Rebuild:
    def __init__(self, src: Sources, gap_seconds: int = 300):
        self.src = src
        self.gap = gap_seconds

    @cached_property
    def latest(self) -> DataFrame:
        return clean.prepare_demand(self.src.latest)

    @cached_property
    def previous(self) -> DataFrame | None:
        return clean.prepare_demand(self.src.previous) if self.src.previous is not None else None

    @cached_property
    def windows(self) -> P.Periods:
        return P.select_periods(self.latest, self.previous, self.gap)

    @cached_property
    def history(self) -> tuple[DataFrame, DataFrame]:
        return facts.stored_history(self.latest, self.previous, self.gap)

    @cached_property
    def summary(self) -> DataFrame:
        return cut_lineage(S.demand_summary(self.windows.current), "demand_summary")

    @cached_property
    def funnel(self) -> DataFrame:
        return cut_lineage(
            FN.hotel_date_funnel(
                self.windows.current,
                self.windows.baseline,
                feeds.bookings(self.src.bookings),
                feeds.internal_parity(self.src.internal_parity),
                feeds.ota_parity(self.src.ota_parity),
            ),
            "hotel_date_funnel",
        )

    @cached_property
    def engine(self) -> DataFrame:
        return E.build_engine(self.summary, self.src.master, self.src.performance, self.funnel)

    def outputs(self) -> dict[str, DataFrame]:
        hotels, destinations = self.history
        return {
            "demand_summary": self.summary,
            "hotel_date_funnel": self.funnel,
            "engine": self.engine,
            "historical_hotel_date": hotels,
            "historical_destination_date": destinations,
        }


def run(src: Sources, gap_seconds: int = 300) -> dict[str, DataFrame]:
    return Rebuild(src, gap_seconds).outputs()
