"""Daily comparison views in bulk form: one job for every check-in date.

The original page computes these for one selected date (and destination
filter); here each view keeps ``checkin_date`` as a key, so all dates come
out of one distributed plan.  Quantile thresholds are exact
(linear interpolation like pandas) and grouped by date, counted without
holding a date's values in one task (``quantiles``);
top-k lists use ``row_number`` per date, which Spark limits per partition
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from staylens.functions import columns as C
from staylens.operators.joins import assert_unique, join_small
from staylens.operators.quantiles import group_quantiles

METRIC_COLUMNS = [
    "Destination_Searches", "Previous_Destination_Searches", "Comparable_Destination_Searches",
    "Previous_Comparable_Destination_Searches", "Destination_Search_Change", "Previous_Views",
    "Comparable_Views", "Previous_Comparable_Views", "View_Change",
]
RISING_SIGNALS = ["Critical surge", "High increase", "New demand"]
# Work-priority texts.
WORK_PRIORITY = [
    "Urgent — high views and rising",
    "High — high views, even if stable",
    "Medium — lower views but rising",
    "Routine — low or zero views without growth",
]


def home_detail(funnel: DataFrame, engine: DataFrame) -> DataFrame:
    """funnel rows with Region / hotel type; missing metrics as NULL; dated rows only."""
    hm = engine.select("ProductID", "Region", "`HotelType Short`").dropDuplicates(["ProductID"])
    d = funnel.join(hm, on="ProductID", how="left").withColumn(
        "view_volume", F.coalesce(F.col("view_volume").cast("double"), F.lit(0.0))
    )
    for c in METRIC_COLUMNS:
        d = d.withColumn(c, F.col(c).cast("double") if c in d.columns else F.lit(None).cast("double"))
    return d.where(F.col("checkin_date").isNotNull())


def with_metric_columns(detail: DataFrame) -> DataFrame:
    """Missing comparison metrics as NULL doubles (a detail without a baseline)."""
    missing = {c: F.lit(None).cast("double") for c in METRIC_COLUMNS if c not in detail.columns}
    return detail.withColumns(missing) if missing else detail


def _destination_days(detail: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per (scope, check-in date, destination) of the detail (NULL destination included)."""
    return with_metric_columns(detail).groupBy(*scope, "checkin_date", "Destination").agg(
        *[F.max(c).alias(c) for c in [
            "Destination_Searches", "Previous_Destination_Searches",
            "Previous_Comparable_Destination_Searches", "Destination_Search_Change",
        ]]
    )


def level(value: Column, thresholds: list[tuple[Column, str]], default: str) -> Column:
    expr = None
    for q, label in thresholds:
        expr = F.when(value >= q, label) if expr is None else expr.when(value >= q, label)
    return expr.otherwise(default)


def daily_market(detail: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """A8 + W3: per date searches (distinct destination-days), views, hotels, demand level.

    With a ``scope`` (the snapshot week of a weekly detail) each of its values is
    a page of its own: dates are grouped, and levels set, within it.
    """
    day = [*scope, "checkin_date"]
    searches = _destination_days(detail, scope).groupBy(*day).agg(C.sum0("Destination_Searches").alias("Searches"))
    hotels = detail.groupBy(*day).agg(
        C.sum0("view_volume").alias("Views"), F.count_distinct("ProductID").alias("Hotels")
    )
    daily = searches.join(hotels, on=day, how="full_outer")
    if scope:
        daily = join_small(daily, group_quantiles(daily, scope, F.col("Searches"), [0.40, 0.75, 0.90]), on=list(scope), how="left")
        q = F.col("_q")
        return daily.withColumn("Demand Level", level(F.col("Searches"), [(q[2], "Very High"), (q[1], "High"), (q[0], "Medium")], "Low")).drop("_q")
    qs = daily.agg(F.percentile("Searches", [0.40, 0.75, 0.90])).scalar()
    return daily.withColumn(
        "Demand Level",
        level(F.col("Searches"), [(qs[2], "Very High"), (qs[1], "High"), (qs[0], "Medium")], "Low"),
    )


def destination_signal_daily(detail: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per (date, destination): New demand / Critical surge / High increase / Declining / Stable."""
    d = _destination_days(detail, scope)
    pct = C.ratio_if_positive("Destination_Search_Change", "Previous_Comparable_Destination_Searches")
    return d.select(
        *scope, "checkin_date", "Destination",
        F.when(F.col("Previous_Destination_Searches").isNull(), "New demand")
        .otherwise(C.pct_signal(pct))
        .alias("Destination Signal"),
    )


def hotel_signal_daily(detail: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per funnel row, view change % and hotel signal; W11 action flag per row."""
    pct = C.ratio_if_positive("View_Change", "Previous_Comparable_Views")
    rows = detail.withColumn("View Change %", pct).withColumn(
        "Hotel Signal",
        F.when(F.col("Previous_Views").isNull() | C.flag(F.col("check_status") == "new entry"), "New interest")
        .otherwise(C.pct_signal(F.col("`View Change %`"))),
    )
    signals = destination_signal_daily(detail, scope)
    same = F.col("r.checkin_date") == F.col("s.checkin_date")
    for c in scope:
        same = same & (F.col(f"r.{c}") == F.col(f"s.{c}"))
    # NULL destinations match each other here, as in the original merge
    joined = rows.alias("r").join(
        signals.alias("s"),
        same & F.col("r.Destination").eqNullSafe(F.col("s.Destination")),
        "left",
    ).select("r.*", "s.`Destination Signal`")
    day = [*scope, "checkin_date"]
    q75 = group_quantiles(detail, day, F.col("view_volume"), [0.75])
    joined = join_small(joined, q75, on=day, how="left")
    action = F.col("`Destination Signal`").isin(RISING_SIGNALS) & (
        C.flag(F.col("View_Change") > 0) | C.flag(F.col("view_volume") >= F.col("_q")[0])
    )
    return joined.withColumn("Action", C.flag(action)).drop("_q")


def daily_kpis(detail: DataFrame, history_destinations: DataFrame, daily: DataFrame) -> DataFrame:
    """F14 + W10 + W11 per check-in date."""
    dest = _destination_days(detail).groupBy("checkin_date").agg(
        C.sum0("Destination_Searches").alias("Latest_Window_Searches"),
        F.sum("Previous_Comparable_Destination_Searches").alias("Previous_Searches"),
        F.sum("Destination_Search_Change").alias("Search_Change"),
    )
    rows = hotel_signal_daily(detail)
    hotels = rows.groupBy("checkin_date").agg(
        F.count_distinct("ProductID").alias("Active_Hotels"),
        F.count_if(C.flag(F.col("View_Change") > 0)).alias("Rising_Hotels"),
        F.count_if(F.col("Action")).alias("Action_Hotels"),
    )
    observed = history_destinations.groupBy("checkin_date").agg(
        C.sum0("Total_Observed_Searches").alias("Total_Observed_Searches")
    )
    pct = F.when((F.col("Previous_Searches") != 0) & F.col("Search_Change").isNotNull(),
                 F.col("Search_Change") / F.col("Previous_Searches"))
    out = (
        dest.join(hotels, on="checkin_date", how="inner")
        .join(observed, on="checkin_date", how="left")
        .join(daily.select("checkin_date", "Demand Level"), on="checkin_date", how="left")
        .withColumn("Total_Observed_Searches", F.coalesce("Total_Observed_Searches", F.lit(0.0)))
        .withColumn("Total_Observed_Searches_Display", C.half_up_int("Total_Observed_Searches").cast("bigint"))
        .withColumn("Change_Pct", pct)
    )
    return out.withColumn("Date_Signal", C.pct_signal("Change_Pct", "No baseline"))


def history_daily(history_hotels: DataFrame, history_destinations: DataFrame) -> DataFrame:
    """A12 + hotel counts + W3 level over stored history (the 'strong dates' table)."""
    s = history_destinations.groupBy("checkin_date").agg(F.sum("Total_Observed_Searches").alias("Searches"))
    v = history_hotels.groupBy("checkin_date").agg(
        F.sum("Total_Observed_Views").alias("Views"), F.count_distinct("ProductID").alias("Hotels")
    )
    daily = s.join(v, on="checkin_date", how="full_outer")
    qs = daily.agg(F.percentile("Searches", [0.40, 0.75, 0.90])).scalar()
    return daily.withColumn(
        "Demand Level",
        level(F.col("Searches"), [(qs[2], "Very High"), (qs[1], "High"), (qs[0], "Medium")], "Low"),
    )


def strongest_dates(history_day: DataFrame, n: int = 5) -> DataFrame:
    """The n dates with most stored searches (earlier date first on ties)."""
    return history_day.orderBy(F.col("Searches").desc_nulls_last(), F.col("checkin_date").asc()).limit(n)


def map_table(history_hotels: DataFrame, history_destinations: DataFrame, coordinates: DataFrame) -> DataFrame:
    """A13 + W5 per date: destination searches and views on mapped destinations, level."""
    s = history_destinations.select("checkin_date", "Destination", F.col("Total_Observed_Searches").alias("Searches"))
    v = history_hotels.groupBy("checkin_date", "Destination").agg(F.sum("Total_Observed_Views").alias("Views"))
    m = s.join(v, on=["checkin_date", "Destination"], how="full_outer")
    # coordinates: one row per mapped destination (a fixed reference list)
    m = join_small(m, coordinates, on="Destination", how="inner", bounded=True).withColumns(
        {"Searches": F.coalesce("Searches", F.lit(0.0)), "Views": F.coalesce("Views", F.lit(0.0))}
    )
    positive = F.when(F.col("Searches") > 0, F.col("Searches"))
    qs = group_quantiles(m, ["checkin_date"], positive, [0.20, 0.50, 0.75, 0.90])
    m = join_small(m, qs, on="checkin_date", how="left")
    q = [F.coalesce(F.col("_q")[i], F.lit(0.0)) for i in range(4)]
    lvl = level(F.col("Searches"), [(q[3], "Very High"), (q[2], "High"), (q[1], "Medium"), (q[0], "Low")], "Very Low")
    return m.withColumn("Demand Level", lvl).drop("_q")


# Map names that differ from the destination's name in the demand data.
PROVINCE_ALIASES = {
    "Amnat Charoen": "Amnart Charoen",
    "Bangkok Metropolis": "Bangkok",
    "Bueng Kan": "Bungkan",
    "Buri Ram": "Buriram",
    "Chai Nat": "Chainat",
    "Chon Buri": "Chonburi",
    "Nakhon Ratchasima": "Nakhonratchasima",
    "Nong Bua Lam Phu": "Nong Bua Lamphu",
    "Phangnga": "Phang Nga",
    "Phatthalung": "Phattalung",
    "Prachuap Khiri Khan": "Prachuapkhirikhan",
}


def alias_table(spark: SparkSession, aliases: dict[str, str] = PROVINCE_ALIASES) -> DataFrame:
    return spark.createDataFrame(sorted(aliases.items()), "alias string, Destination string")


def provinces_with_destination(provinces: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each map name (``province``) with the destination it stands for: its alias's, else its own name.

    Both lists are small reference tables; an alias listed twice would give a
    name two destinations and is an error.
    """
    known = assert_unique(aliases.select("alias", F.col("Destination").alias("_d")), ["alias"], "aliases")
    rows = provinces.select("province").distinct().join(known, F.col("province") == F.col("alias"), "left")
    return rows.select("province", F.coalesce("_d", "province").alias("Destination"))


def province_demand(mapped: DataFrame, provinces: DataFrame, aliases: DataFrame) -> DataFrame:
    """J16 + A13: the map table by province, many spellings of one destination each with its demand."""
    return mapped.join(provinces_with_destination(provinces, aliases), on="Destination", how="inner")


def unmatched_provinces(mapped: DataFrame, provinces: DataFrame, aliases: DataFrame) -> DataFrame:
    """Map names whose destination has no demand on any date (drawn as 'Very Low')."""
    return provinces_with_destination(provinces, aliases).join(mapped.select("Destination").distinct(), on="Destination", how="left_anti")


def work_priority(views: Column, change: Column, q80: Column) -> Column:
    """High views (> 0 and >= q80) and/or rising views."""
    high = C.flag((views > 0) & (views >= q80))
    rising = C.flag(change > 0)
    return (
        F.when(high & rising, WORK_PRIORITY[0])
        .when(high, WORK_PRIORITY[1])
        .when(rising, WORK_PRIORITY[2])
        .otherwise(WORK_PRIORITY[3])
    )


def date_worklist(history_hotels: DataFrame, detail: DataFrame, n: int = 12) -> DataFrame:
    """W14 + W4 per check-in date: top hotels by stored views, with recent signals."""
    recent = hotel_signal_daily(detail).select(
        "checkin_date", "ProductID", "`View Change %`", "View_Change", "`Hotel Signal`",
        "`Destination Signal`", "Region",
    ).dropDuplicates(["checkin_date", "ProductID"])
    t = history_hotels.join(recent, on=["checkin_date", "ProductID"], how="left").withColumns(
        {
            "Hotel Signal": F.coalesce("`Hotel Signal`", F.lit("No recent observation")),
            "Destination Signal": F.coalesce("`Destination Signal`", F.lit("No recent observation")),
        }
    )
    qs = group_quantiles(history_hotels, ["checkin_date"], F.col("Total_Observed_Views"), [0.50, 0.80])
    w = Window.partitionBy("checkin_date").orderBy(
        F.col("Total_Observed_Views").desc_nulls_last(),
        F.col("View_Change").desc_nulls_last(),
        F.col("ProductName").asc_nulls_last(),
        F.col("ProductID").asc(),
    )
    # filter on the raw row number so Spark limits each date per partition
    # before the shuffle (WindowGroupLimit): a busy date never lands whole in a task
    top = (
        t.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= n)
        .withColumn("Priority", F.col("_rn").cast("bigint"))
        .drop("_rn")
    )
    top = join_small(top, qs, on="checkin_date", how="left")
    views = F.col("Total_Observed_Views")
    lvl = level(views, [(F.col("_q")[1], "Very High"), (F.col("_q")[0], "High")], "Medium")
    top = top.withColumn("Demand Level", lvl)
    why = (
        F.when(F.col("`Destination Signal`").isin("Critical surge", "High increase") & C.flag(F.col("View_Change") > 0),
               "Destination rising + hotel views rising")
        .when(F.col("`Demand Level`") == "Very High", "High hotel views")
        .otherwise("Hotel interest to monitor")
    )
    return top.withColumn("Why prioritized", why).withColumn(
        "Work Priority", work_priority(views, F.col("View_Change"), F.col("_q")[1])
    ).drop("_q")


def portfolio_kpis(engine: DataFrame) -> DataFrame:
    """One row of portfolio counters."""
    return engine.agg(
        F.count(F.lit(1)).alias("Hotels"),
        F.count_if(F.col("Priority") == "Critical").alias("Critical"),
        F.count_if(F.col("Priority") == "High").alias("High"),
        F.sum("Revenue").alias("Revenue"),
        C.rint1(F.avg("`Opportunity Index`")).alias("Avg_Opportunity"),
    )


def priority_counts(engine: DataFrame) -> DataFrame:
    """Hotels per priority band."""
    return engine.groupBy("Priority").agg(F.count(F.lit(1)).alias("count"))


def engine_validation(engine: DataFrame) -> DataFrame:
    """Row count against distinct ProductID."""
    return engine.agg(
        F.count(F.lit(1)).alias("Rows"), F.count_distinct("ProductID").alias("Unique_ProductIDs")
    ).withColumn("No_Duplicates", F.col("Rows") == F.col("Unique_ProductIDs"))
