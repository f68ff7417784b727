"""Week comparisons in bulk form.

The original compares one selected ISO week with the week before.  Here
every week is a key.  Snapshot weeks are summarised once and the summaries
joined to themselves seven days on.  In the check-in views every row is sent
to two target weeks (its own week as the current period and the following
week as the previous period: a fixed 2x expansion, no pairs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from staylens.functions import columns as C
from staylens.operators import facts
from staylens.operators.batches import with_batches
from staylens.operators.joins import join_small
from staylens.operators.quantiles import group_quantiles
from staylens.operators.ranking import global_row_number
from staylens.session import cut_lineage
from staylens.operators.views import WORK_PRIORITY, level, work_priority

# Signal sort orders of the weekly worklist.
HOTEL_SIGNAL_ORDER = {"Critical surge": 5, "High increase": 4, "New interest": 3, "Stable": 2, "Declining": 1}
DEST_SIGNAL_ORDER = {"Critical surge": 5, "High increase": 4, "New demand": 3, "Stable": 2, "Declining": 1}


def monday(d: Column) -> Column:
    """ISO week start (Monday) of a date."""
    return F.date_sub(d, (F.dayofweek(d) + 5) % 7)


def week_label(start: Column) -> Column:
    """``YYYY-Www (dd Mon–dd Mon)`` with the ISO year and week."""
    return F.concat(
        F.year(F.date_add(start, 3)).cast("string"),  # ISO year = year of the week's Thursday
        F.lit("-W"),
        F.lpad(F.weekofyear(start).cast("string"), 2, "0"),
        F.lit(" ("),
        F.date_format(start, "dd MMM"),
        F.lit("–"),
        F.date_format(F.date_add(start, 6), "dd MMM"),
        F.lit(")"),
    )


def week_options(demand: DataFrame) -> DataFrame:
    """distinct ISO snapshot weeks with their labels."""
    weeks = demand.where(F.col("snapshot_at").isNotNull()).select(
        monday(F.to_date("snapshot_at")).alias("week_start")
    ).distinct()
    return weeks.withColumn("label", week_label(F.col("week_start")))


def checkin_week_options(detail: DataFrame) -> DataFrame:
    """distinct ISO check-in weeks with their labels."""
    weeks = detail.where(F.col("checkin_date").isNotNull()).select(monday(F.col("checkin_date")).alias("week_start")).distinct()
    return weeks.withColumn("label", week_label(F.col("week_start")))


def _two_weeks(rows: DataFrame, day: Column, options: DataFrame) -> DataFrame:
    """Each row once for its own week ('latest') and once for the next ('previous')."""
    wk = monday(day)
    targets = F.explode(
        F.array(
            F.struct(wk.alias("week_start"), F.lit("latest").alias("period")),
            F.struct(F.date_add(wk, 7).alias("week_start"), F.lit("previous").alias("period")),
        )
    )
    out = rows.select("*", targets.alias("_t")).select("*", "_t.week_start", "_t.period").drop("_t")
    # one row per calendar week: bounded by the calendar
    return join_small(out, options.select("week_start"), on="week_start", how="left_semi", bounded=True)


WEEK_ROWS = ["snapshot_at", "checkin_date", "ProductID", "ProductName", "Destination", "check_status", "hotness_score",
             "trend_momentum", "search_volume", "view_volume", "load_seq", "row_seq"]
WEEK_HOTEL = ["week_start", "ProductID", "checkin_date"]
WEEK_DESTINATION = ["week_start", "Destination", "checkin_date"]


def week_summaries(demand: DataFrame, gap_seconds: int = 300) -> tuple[DataFrame, DataFrame]:
    """Hotel and destination facts per ISO snapshot week and check-in date.

    A comparison batches its two weeks jointly but groups them apart, so of a
    batch that straddles the Monday each week sees its own part: the first (or
    last) run of its own stamps.  A week's facts are therefore the same as the
    current week of one comparison and as the previous week of the next, and
    depend on no other week: summaries of different weeks are merged by union.
    Rows are read once and written with their batches, for both tables.
    """
    rows = demand.where(F.col("snapshot_at").isNotNull() & F.col("checkin_date").isNotNull()).select(
        *WEEK_ROWS, monday(F.to_date("snapshot_at")).alias("week_start")
    )
    rows = rows.withColumns({"view_volume": F.coalesce("view_volume", F.lit(0.0)), "check_status": C.demand_status("check_status")})
    rows = cut_lineage(rows, "week_rows")
    b = with_batches(rows, gap_seconds, scope=["week_start"])
    kept = facts.latest_per_key(b.where(F.col("ProductID").isNotNull()), [*WEEK_HOTEL, "Observation_Batch"], null_keys=False)
    hotels = kept.groupBy(*WEEK_HOTEL).agg(
        C.sum0("view_volume").alias("view_volume"),
        F.count(F.lit(1)).alias("Interval_Count"),
        F.avg("hotness_score").alias("hotness_score"),
        F.avg("trend_momentum").alias("trend_momentum"),
        F.max_by(
            F.struct("ProductName", "Destination", "snapshot_at", "check_status"), F.struct(*facts.ORDER)
        ).alias("_m"),
    ).select(*WEEK_HOTEL, "view_volume", "Interval_Count", "hotness_score", "trend_momentum", "_m.*")
    medians = b.where(F.col("Destination").isNotNull()).groupBy(*WEEK_DESTINATION, "Observation_Batch").agg(
        F.median("search_volume").alias("search_volume"), F.max("snapshot_at").alias("snapshot_at")
    )
    destinations = medians.groupBy(*WEEK_DESTINATION).agg(
        C.sum0("search_volume").alias("Destination_Searches"),
        F.max("snapshot_at").alias("Destination_Search_Snapshot"),
        F.count(F.lit(1)).alias("Destination_Intervals"),
    )
    return cut_lineage(hotels, "week_hotels"), cut_lineage(destinations, "week_destinations")


def _next_week(facts_of_week: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """A week's facts under the week that compares itself with it."""
    return facts_of_week.select(
        F.date_add("week_start", 7).alias("week_start"), *keys[1:], *[F.col(c).alias(n) for c, n in names.items()]
    )


def compare_weeks(hotels: DataFrame, destinations: DataFrame) -> DataFrame:
    """F7 from week summaries: each week's facts against those of the week before."""
    previous = _next_week(hotels, WEEK_HOTEL, {"view_volume": "Previous_Views", "Interval_Count": "Previous_View_Intervals"})
    hotels = hotels.join(previous, on=WEEK_HOTEL, how="left")
    k = C.min_strict("Interval_Count", "Previous_View_Intervals")
    hotels = hotels.withColumns(
        {
            "Comparable_View_Intervals": k,
            "Comparable_Views": F.col("view_volume") / F.col("Interval_Count") * k,
            "Previous_Comparable_Views": C.guarded_div("Previous_Views", "Previous_View_Intervals") * k,
        }
    ).withColumn("View_Change", F.col("Comparable_Views") - F.col("Previous_Comparable_Views"))

    before = _next_week(
        destinations, WEEK_DESTINATION,
        {"Destination_Searches": "Previous_Destination_Searches", "Destination_Intervals": "Previous_Destination_Intervals"},
    )
    dk = C.min_strict("Destination_Intervals", "Previous_Destination_Intervals")
    dest = destinations.join(before, on=WEEK_DESTINATION, how="left").withColumns(
        {
            "Comparable_Destination_Intervals": dk,
            "Comparable_Destination_Searches": F.col("Destination_Searches") / F.col("Destination_Intervals") * dk,
            "Previous_Comparable_Destination_Searches": C.guarded_div(
                "Previous_Destination_Searches", "Previous_Destination_Intervals"
            ) * dk,
            "Previous_Destination_Search_Snapshot": F.col("week_start").cast("timestamp_ntz")
            - F.expr("INTERVAL '1' SECOND"),
        }
    ).withColumn(
        "Destination_Search_Change",
        F.col("Comparable_Destination_Searches") - F.col("Previous_Comparable_Destination_Searches"),
    )
    out = hotels.join(dest, on=WEEK_DESTINATION, how="left")
    status = (
        F.when(F.col("Previous_Views").isNull(), "New")
        .when(F.col("View_Change") > 0, "Increase")
        .when(F.col("View_Change") < 0, "Decrease")
        .otherwise("No change")
    )
    return out.withColumn("Upload_Change_Status", status)


def snapshot_week(demand: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """each ISO snapshot week against the week before (hotel x check-in rows)."""
    return compare_weeks(*week_summaries(demand, gap_seconds))


def checkin_detail(full_history: DataFrame, engine: DataFrame) -> DataFrame:
    """Input of the check-in week view: all-history hotel rows of engine hotels (F13 applied)."""
    from staylens.operators.views import home_detail

    rows = full_history.join(engine.select("ProductID"), on="ProductID", how="left_semi")
    return home_detail(rows, engine).withColumn(
        "Destination_Searches", F.coalesce(F.col("Destination_Searches"), F.lit(0.0))
    )


def _checkin_two_weeks(detail: DataFrame) -> DataFrame:
    options = detail.select(monday(F.col("checkin_date")).alias("week_start")).distinct()
    rows = _two_weeks(detail, F.col("checkin_date"), options)
    return rows.withColumn("period", F.when(F.col("period") == "latest", "current").otherwise("previous"))


def checkin_week_destinations(detail: DataFrame) -> DataFrame:
    """per target week and destination, summed searches of both weeks, change, pct."""
    rows = _checkin_two_weeks(detail).where(F.col("Destination").isNotNull())
    per_day = rows.groupBy("week_start", "period", "Destination", "checkin_date").agg(
        F.max("Destination_Searches").alias("s")
    )
    cur = per_day.where(F.col("period") == "current").groupBy("week_start", "Destination").agg(
        F.sum("s").alias("Current_Searches")
    )
    prev = per_day.where(F.col("period") == "previous").groupBy("week_start", "Destination").agg(
        F.sum("s").alias("Previous_Searches")
    )
    d = cur.join(prev, on=["week_start", "Destination"], how="full_outer").withColumns(
        {
            "Current_Searches": F.coalesce("Current_Searches", F.lit(0.0)),
            "Previous_Searches": F.coalesce("Previous_Searches", F.lit(0.0)),
        }
    )
    d = d.withColumn("Search_Change", F.col("Current_Searches") - F.col("Previous_Searches"))
    return d.withColumn("Change_Pct", C.ratio_if_positive("Search_Change", "Previous_Searches"))


def week_hotel_metrics(detail: DataFrame) -> DataFrame:
    """F8 + W7 + W9 + W11 + W12: hotels of each check-in week against the week before, not ranked."""
    rows = _checkin_two_weeks(detail)
    cur = rows.where(F.col("period") == "current").groupBy("week_start", "ProductID").agg(
        # pandas ``last``: the last non-NULL value in check-in date order
        F.expr("max_by(ProductName, checkin_date) FILTER (WHERE ProductName IS NOT NULL)").alias("ProductName"),
        F.expr("max_by(Destination, checkin_date) FILTER (WHERE Destination IS NOT NULL)").alias("Destination"),
        C.sum0("view_volume").alias("Current_Views"),
        F.count_distinct("checkin_date").alias("CheckIn_Days"),
        F.first("Region", ignorenulls=True).alias("Region"),
    )
    prev = rows.where(F.col("period") == "previous").groupBy("week_start", "ProductID").agg(
        C.sum0("view_volume").alias("Previous_Views")
    )
    h = cur.join(prev, on=["week_start", "ProductID"], how="left")
    h = h.withColumn("View_Change", F.col("Current_Views") - F.col("Previous_Views")).withColumn(
        "View_Change_Pct", C.ratio_if_positive("View_Change", "Previous_Views")
    )
    dest = checkin_week_destinations(detail).select(
        "week_start", "Destination", "Current_Searches", "Previous_Searches", "Search_Change", "Change_Pct"
    )
    h = h.join(dest, on=["week_start", "Destination"], how="left")
    dsig = (
        F.when(C.flag((F.col("Previous_Searches") == 0) & (F.col("Current_Searches") > 0)), "New demand")
        .otherwise(C.pct_signal("Change_Pct"))
    )
    hsig = F.when(F.col("Previous_Views").isNull(), "New interest").otherwise(C.pct_signal("View_Change_Pct"))
    h = h.withColumns({"Destination Signal": dsig, "Hotel Signal": hsig})
    qs = group_quantiles(h, ["week_start"], F.col("Current_Views"), [0.75, 0.80])
    h = join_small(h, qs, on="week_start", how="left")
    action = F.col("`Destination Signal`").isin("Critical surge", "High increase", "New demand") & (
        C.flag(F.col("View_Change") > 0) | C.flag(F.col("Current_Views") >= F.col("_q")[0])
    )
    h = h.withColumn("Action", C.flag(action))
    h = h.withColumn("Work Priority", work_priority(F.col("Current_Views"), F.col("View_Change"), F.col("_q")[1]))
    h_order = _map_order("`Hotel Signal`", HOTEL_SIGNAL_ORDER)
    d_order = _map_order("`Destination Signal`", DEST_SIGNAL_ORDER)
    return h.withColumns({"_ho": h_order, "_do": d_order}).drop("_q")


def _worklist_order() -> list[Column]:
    """Sort keys of a week's hotels (a total order)."""
    return [
        (F.col("Current_Views") > 0).desc(),
        F.col("Current_Views").desc_nulls_last(),
        F.col("_ho").desc(),
        F.col("_do").desc(),
        F.col("View_Change").desc_nulls_last(),
        F.col("ProductID").asc(),
    ]


def checkin_week_hotels(detail: DataFrame) -> DataFrame:
    """F8 + W13: hotels of each check-in week with their rank in it."""
    # one row per hotel and week, scanned twice by the rank below: written once
    h = cut_lineage(week_hotel_metrics(detail), "week_hotels")
    # W13 rank within the week: a global row number over (week, sort keys)
    # minus the rows of earlier weeks, so no week is ranked inside one task
    ranked = global_row_number(h, [F.col("week_start").asc(), *_worklist_order()], "_rank")
    per_week = h.groupBy("week_start").agg(F.count(F.lit(1)).alias("_n"))
    offsets = per_week.withColumn(
        "_before",
        F.coalesce(F.sum("_n").over(Window.orderBy("week_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select("week_start", "_before")
    # one row per calendar week: bounded by the calendar
    ranked = join_small(ranked, offsets, on="week_start", how="inner", bounded=True)
    return ranked.withColumn("Priority", (F.col("_rank") - F.col("_before")).cast("bigint")).drop(
        "_ho", "_do", "_rank", "_before"
    )


WORKLIST_SALTS = 32


def week_worklist(detail: DataFrame, n: int = 200) -> DataFrame:
    """The first n hotels of every check-in week, without ranking the rest.

    Each of WORKLIST_SALTS parts of a week is cut to n rows, and the week's rank
    taken among those.  Both filters are on row numbers, so Spark limits every
    task's rows per key before it shuffles them: no week is sorted as a whole.
    """
    h = week_hotel_metrics(detail).withColumn("_salt", F.pmod(F.xxhash64("ProductID"), F.lit(WORKLIST_SALTS)))
    part = Window.partitionBy("week_start", "_salt").orderBy(*_worklist_order())
    h = h.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    week = Window.partitionBy("week_start").orderBy(*_worklist_order())
    h = h.withColumn("_rn", F.row_number().over(week)).where(F.col("_rn") <= n)
    return h.withColumn("Priority", F.col("_rn").cast("bigint")).drop("_rn", "_ho", "_do")


def _map_order(col: str, table: dict[str, int]) -> Column:
    expr = None
    for label, order in table.items():
        expr = F.when(F.col(col) == label, order) if expr is None else expr.when(F.col(col) == label, order)
    return expr.otherwise(0)


def checkin_week_daily(detail: DataFrame) -> DataFrame:
    """per target week and check-in date, searches and views of both weeks, aligned."""
    rows = _checkin_two_weeks(detail)
    per_dest = rows.groupBy("week_start", "period", "checkin_date", "Destination").agg(
        F.max("Destination_Searches").alias("s")
    )
    searches = per_dest.groupBy("week_start", "period", "checkin_date").agg(F.sum("s").alias("Searches"))
    views = rows.groupBy("week_start", "period", "checkin_date").agg(F.sum("view_volume").alias("Views"))
    d = searches.join(views, on=["week_start", "period", "checkin_date"], how="full_outer")
    # column names are case-insensitive: move the internal period aside first
    d = d.withColumnRenamed("period", "_p")
    shift = F.when(F.col("_p") == "previous", 7).otherwise(0)
    d = d.withColumn("Matched_Date", F.date_add("checkin_date", shift))
    d = d.withColumn("Period", F.when(F.col("_p") == "current", "Selected week").otherwise("Previous week"))
    return d.withColumn("Weekday", F.date_format("Matched_Date", "EEE")).drop("_p")


def checkin_week_kpis(detail: DataFrame) -> DataFrame:
    """per check-in week, totals or per-day averages, change, pct and signal."""
    dest = checkin_week_destinations(detail).groupBy("week_start").agg(
        F.sum("Current_Searches").alias("Current_Total"), F.sum("Previous_Searches").alias("Previous_Total")
    )
    days = checkin_week_daily(detail).groupBy("week_start").agg(
        F.count_distinct(F.when(F.col("Period") == "Selected week", F.col("checkin_date"))).alias("Current_Days"),
        F.count_distinct(F.when(F.col("Period") == "Previous week", F.col("checkin_date"))).alias("Previous_Days"),
    )
    hotels = week_hotel_metrics(detail).groupBy("week_start").agg(
        F.count_if(C.flag(F.col("View_Change") > 0)).alias("Rising_Hotels"),
        F.count(F.lit(1)).alias("Hotels"),
        F.count_if(F.col("Action")).alias("Action_Hotels"),
    )
    k = dest.join(days, on="week_start", how="inner").join(hotels, on="week_start", how="left")
    complete = (F.col("Current_Days") == 7) & (F.col("Previous_Days") == 7)

    def basis(total, n):
        return F.when(complete, F.col(total)).when(F.col(n) != 0, F.col(total) / F.col(n))

    k = k.withColumns({"Current_Basis": basis("Current_Total", "Current_Days"),
                       "Previous_Basis": basis("Previous_Total", "Previous_Days")})
    k = k.withColumn("Change", F.col("Current_Basis") - F.col("Previous_Basis"))
    k = k.withColumn("Change_Pct", F.when(F.col("Previous_Basis") != 0, F.col("Change") / F.col("Previous_Basis")))
    return k.withColumn("Complete", complete).withColumn("Signal", C.pct_signal("Change_Pct", "No baseline"))


def unpivot_trend(daily: DataFrame) -> DataFrame:
    """wide Searches / Views to (Metric, Volume) rows."""
    ids = [c for c in daily.columns if c not in ("Searches", "Views")]
    return daily.unpivot(ids, ["Searches", "Views"], "Metric", "Volume")


def snapshot_freshness(demand: DataFrame) -> DataFrame:
    """F16: newest snapshot within every ISO snapshot week."""
    return (
        demand.where(F.col("snapshot_at").isNotNull())
        .groupBy(monday(F.to_date("snapshot_at")).alias("week_start"))
        .agg(F.max("snapshot_at").alias("Latest_Snapshot"), F.count(F.lit(1)).alias("Rows"))
    )


def freshness(demand: DataFrame, daily: DataFrame) -> DataFrame:
    """F16: one row with the newest snapshot overall and the number of High + Very High dates of a daily level table."""
    newest = demand.agg(F.max("snapshot_at").alias("Latest_Snapshot"))
    high = daily.agg(F.count_if(F.col("`Demand Level`").isin("Very High", "High")).alias("High_Dates"))
    return newest.crossJoin(high)  # one row each


__all__ = [
    "week_options", "checkin_week_options", "freshness", "snapshot_week", "week_summaries", "compare_weeks", "checkin_detail", "checkin_week_destinations", "checkin_week_hotels", "week_hotel_metrics",
    "week_worklist", "checkin_week_daily", "checkin_week_kpis", "unpivot_trend", "snapshot_freshness",
    "level", "WORK_PRIORITY",
]
