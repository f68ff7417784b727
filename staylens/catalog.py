"""Registry of the queries checked against the SQL oracle.

driver tables.  Double columns are rounded to 9 places for the
comparison (both sides).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from staylens import oracle as O
from staylens.functions.columns import round_doubles
from staylens.operators import batches, clean, facts
from staylens.sources import driver_tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def bigint_counts(sql: str) -> str:
    """``count_if(x)`` -> ``count(*) FILTER (WHERE x)``: BIGINT (not HUGEINT) and 0 on no rows."""
    out, i, token = [], 0, "count_if("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        k, depth = j + len(token), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "count(*) FILTER (WHERE " + bigint_counts(sql[j + len(token):k - 1]) + ")")
        i = k


def register(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = bigint_counts(sql)
        return fn

    return wrap


def latest(spark, sf_dir):
    return clean.prepare_demand(T.demand_latest(spark, sf_dir))


def previous(spark, sf_dir):
    return clean.prepare_demand(T.demand_previous(spark, sf_dir))


def _r(expr: str, alias: str) -> str:
    return f"round({expr}, 9) + 0.0 AS {alias}"


# ---------------------------------------------------------------- A1 - A3

@register(
    "observation_batches",
    O.with_ctes(O.DEMAND_ROWS, O.LATEST, O.batched("latest", "b"))
    + " SELECT snapshot_at, Observation_Batch, Observation_At FROM b_map",
)
def q_observation_batches(spark, sf_dir):
    """A1: batch id and batch end per distinct crawl time stamp (gap 300 s)."""
    return batches.batch_map(latest(spark, sf_dir), 300)


@register(
    "observation_batches_gap30",
    O.with_ctes(O.DEMAND_ROWS, O.LATEST, O.batched("latest", "b", gap=30))
    + " SELECT snapshot_at, Observation_Batch, Observation_At FROM b_map",
)
def q_observation_batches_gap30(spark, sf_dir):
    """A1 with a 30 s gap (many more batches)."""
    return batches.batch_map(latest(spark, sf_dir), 30)


def _hotel_sql(gap: int) -> str:
    return O.with_ctes(
        O.DEMAND_ROWS, O.LATEST, O.batched("latest", "b", gap=gap), O.hotel_checkin("b", "h")
    ) + f""" SELECT ProductID, checkin_date, snapshot_at,
  {_r('hotness_score', 'hotness_score')}, {_r('trend_momentum', 'trend_momentum')},
  {_r('search_volume', 'search_volume')}, {_r('view_volume', 'view_volume')},
  Interval_Count, ProductName, Destination, check_status FROM h"""


def _dest_sql(gap: int) -> str:
    return O.with_ctes(
        O.DEMAND_ROWS, O.LATEST, O.batched("latest", "b", gap=gap), O.destination_checkin("b", "d")
    ) + f""" SELECT Destination, checkin_date, Destination_Search_Snapshot,
  {_r('Destination_Searches', 'Destination_Searches')}, Destination_Intervals FROM d"""


@register("hotel_checkin", _hotel_sql(300))
def q_hotel_checkin(spark, sf_dir):
    """A2: hotel x check-in facts over the latest load (gap 300 s)."""
    return facts.hotel_checkin(latest(spark, sf_dir), 300)


@register("hotel_checkin_gap900", _hotel_sql(900))
def q_hotel_checkin_gap900(spark, sf_dir):
    """A2 with a 900 s gap: several rows per batch, exercising keep-last and median."""
    return facts.hotel_checkin(latest(spark, sf_dir), 900)


@register("destination_checkin", _dest_sql(300))
def q_destination_checkin(spark, sf_dir):
    """A3: destination x check-in searches (median per batch, summed)."""
    return facts.destination_checkin(latest(spark, sf_dir), 300)


@register("destination_checkin_gap900", _dest_sql(900))
def q_destination_checkin_gap900(spark, sf_dir):
    """A3 with a 900 s gap."""
    return facts.destination_checkin(latest(spark, sf_dir), 900)


# ---------------------------------------------------------------- F4, A4, feeds

from staylens.operators import engine as E  # noqa: E402
from staylens.operators import funnel as FN  # noqa: E402
from staylens.operators import periods as P  # noqa: E402
from staylens.operators import summary as S  # noqa: E402
from staylens.plans import rebuild  # noqa: E402
from staylens.session import cut_lineage  # noqa: E402
from staylens.sources import feeds  # noqa: E402

WINDOW_COLS = ["period", "snapshot_at", "ProductID", "checkin_date", "load_seq", "row_seq"]


@register(
    "select_periods",
    O.with_ctes(O.DEMAND_ROWS, O.LATEST, O.PREVIOUS, *O.periods_sql(300))
    + " SELECT 'current' AS period, snapshot_at, ProductID, checkin_date, load_seq, row_seq FROM cur_rows"
    " UNION ALL SELECT 'baseline', snapshot_at, ProductID, checkin_date, load_seq, row_seq FROM base_rows",
)
def q_select_periods(spark, sf_dir):
    """rows of the current window and of the equally long baseline window."""
    w = P.select_periods(latest(spark, sf_dir), previous(spark, sf_dir), 300)
    cur = w.current.withColumn("period", F.lit("current")).select(*WINDOW_COLS)
    if w.baseline is None:
        return cur
    base = w.baseline.withColumn("period", F.lit("baseline")).select(*WINDOW_COLS)
    return cur.unionByName(base)


HIST_SQL = [O.DEMAND_ROWS, O.LATEST, O.PREVIOUS, """
hist_union AS (
  SELECT *, 0 AS _src FROM previous UNION ALL SELECT *, 1 AS _src FROM latest
),
hist AS (
  SELECT * EXCLUDE (_rn, _src) FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_at, checkin_date, ProductID
                                 ORDER BY _src DESC, load_seq DESC, row_seq DESC) AS _rn
    FROM hist_union) WHERE _rn = 1
)""", O.batched("hist", "hb")]


@register(
    "historical_hotel_date",
    O.with_ctes(*HIST_SQL, O.hotel_checkin("hb", "hh"))
    + O.select_rounded(
        ["ProductID", "checkin_date", "Last_Observed_At", "hotness_score", "trend_momentum",
         "search_volume", "Total_Observed_Views", "Historical_View_Intervals", "ProductName",
         "Destination", "check_status"],
        {"hotness_score", "trend_momentum", "search_volume", "Total_Observed_Views"},
        "(SELECT *, snapshot_at AS Last_Observed_At, view_volume AS Total_Observed_Views, "
        "Interval_Count AS Historical_View_Intervals FROM hh)",
    ),
)
def q_historical_hotel_date(spark, sf_dir):
    """A4: all-history hotel facts (previous + latest, deduplicated, re-batched)."""
    return facts.stored_history(latest(spark, sf_dir), previous(spark, sf_dir))[0]


@register(
    "historical_destination_date",
    O.with_ctes(*HIST_SQL, O.destination_checkin("hb", "hd"))
    + O.select_rounded(
        ["Destination", "checkin_date", "Last_Observed_At", "Total_Observed_Searches", "Historical_Search_Intervals"],
        {"Total_Observed_Searches"},
        "(SELECT *, Destination_Search_Snapshot AS Last_Observed_At, Destination_Searches AS "
        "Total_Observed_Searches, Destination_Intervals AS Historical_Search_Intervals FROM hd)",
    ),
)
def q_historical_destination_date(spark, sf_dir):
    """A4: all-history destination facts."""
    return facts.stored_history(latest(spark, sf_dir), previous(spark, sf_dir))[1]


@register(
    "scan_bookings",
    O.with_ctes(O.DEMAND_ROWS, O.FEEDS) + " SELECT ProductID, checkin_date, round(Bookings, 9) + 0.0 AS Bookings FROM bk",
)
def q_scan_bookings(spark, sf_dir):
    """SRC5: bookings per hotel and check-in date."""
    return feeds.bookings(T.booking_rows(spark, sf_dir))


@register(
    "scan_internal_parity",
    O.with_ctes(O.DEMAND_ROWS, O.FEEDS)
    + O.select_rounded(
        ["ProductID", "stay_date", "Internal_Worst_Gap", "Internal_Median_Gap",
         "Internal_Comparable_Rates", "Internal_Total_Rates"],
        {"Internal_Worst_Gap", "Internal_Median_Gap"},
        "(SELECT *, checkin_date AS stay_date FROM ip)",
    ),
)
def q_scan_internal_parity(spark, sf_dir):
    """SRC6: internal rate parity per hotel and stay date."""
    return feeds.internal_parity(T.internal_parity_rows(spark, sf_dir))


@register(
    "scan_ota_parity",
    O.with_ctes(O.DEMAND_ROWS, O.FEEDS)
    + O.select_rounded(
        ["ProductID", "stay_date", "Agoda_Raw_Gap", "Agoda_Price_Disadvantage"],
        {"Agoda_Raw_Gap", "Agoda_Price_Disadvantage"},
        "(SELECT *, checkin_date AS stay_date FROM ota)",
    ),
)
def q_scan_ota_parity(spark, sf_dir):
    """SRC7: wide OTA parity sheet unpivoted, min per key, disadvantage."""
    return feeds.ota_parity(T.ota_parity_wide(spark, sf_dir))


# ---------------------------------------------------------------- F1-F3, A5, engine

def _rebuild(spark, sf_dir, gap=300) -> rebuild.Rebuild:
    return rebuild.Rebuild(rebuild.driver_sources(spark, sf_dir), gap)


@register(
    "hotel_date_funnel",
    O.with_ctes(*O.funnel_sql(300)) + O.select_rounded(FN.FUNNEL_COLUMNS, O.FUNNEL_DOUBLES, "funnel"),
)
def q_hotel_date_funnel(spark, sf_dir):
    """Current funnel with bookings, parity and coverage-normalised change."""
    return _rebuild(spark, sf_dir).funnel


@register(
    "demand_summary",
    O.with_ctes(O.DEMAND_ROWS, O.LATEST, O.PREVIOUS, *O.periods_sql(300), O.SUMMARY)
    + O.select_rounded(O.SUMMARY_COLUMNS, O.SUMMARY_DOUBLES, "summary"),
)
def q_demand_summary(spark, sf_dir):
    """A5 + S1/S2: per-hotel demand summary of the current window."""
    return _rebuild(spark, sf_dir).summary


ENGINE_SQL = O.with_ctes(*O.funnel_sql(300), O.SUMMARY, O.ENGINE)


@register("engine", ENGINE_SQL + O.select_rounded(O.ENGINE_COLUMNS, O.ENGINE_DOUBLES, "engine"))
def q_engine(spark, sf_dir):
    """Ranked hotels with one recommended action."""
    return _rebuild(spark, sf_dir).engine.select(*[F.col(f"`{c}`") for c in O.ENGINE_COLUMNS])


# ---------------------------------------------------------------- daily views (bulk form)

from staylens.operators import views as V  # noqa: E402

FULL = O.with_ctes(*O.full_chain(300))


def _detail(r: rebuild.Rebuild) -> DataFrame:
    return V.home_detail(r.funnel, r.engine)


def _sel(cols, doubles, src):
    return O.select_rounded(cols, set(doubles), src)


HOME_DETAIL_COLS = FN.FUNNEL_COLUMNS + ["Region", "HotelType Short"]


@register("home_detail", FULL + _sel(HOME_DETAIL_COLS, O.FUNNEL_DOUBLES, "detail"))
def q_home_detail(spark, sf_dir):
    """funnel rows with Region and hotel type (dated rows only)."""
    return _detail(_rebuild(spark, sf_dir)).select(*[F.col(f"`{c}`") for c in HOME_DETAIL_COLS])


@register("daily_market", FULL + _sel(["checkin_date", "Searches", "Views", "Hotels", "Demand Level"],
                                      ["Searches", "Views"], "daily"))
def q_daily_market(spark, sf_dir):
    """A8 + W3: searches, views, hotels and demand level per check-in date."""
    return V.daily_market(_detail(_rebuild(spark, sf_dir)))


@register("destination_signal_daily",
          FULL + ' SELECT checkin_date, Destination, "Destination Signal" FROM dsig')
def q_destination_signal_daily(spark, sf_dir):
    """Destination demand signal per check-in date."""
    return V.destination_signal_daily(_detail(_rebuild(spark, sf_dir)))


HSIG_COLS = ["checkin_date", "ProductID", "View Change %", "Hotel Signal", "Destination Signal", "Action"]


@register("hotel_signal_daily", FULL + _sel(HSIG_COLS, ["View Change %"], "hsig"))
def q_hotel_signal_daily(spark, sf_dir):
    """W8 + W11: hotel signal and action flag per hotel and check-in date."""
    return V.hotel_signal_daily(_detail(_rebuild(spark, sf_dir))).select(*[F.col(f"`{c}`") for c in HSIG_COLS])


KPI_COLS = ["checkin_date", "Latest_Window_Searches", "Previous_Searches", "Search_Change", "Active_Hotels",
            "Rising_Hotels", "Action_Hotels", "Total_Observed_Searches", "Total_Observed_Searches_Display",
            "Demand Level", "Change_Pct", "Date_Signal"]
KPI_SQL = FULL + """,
k_dest AS (
  SELECT checkin_date, coalesce(sum(DS), 0.0) AS Latest_Window_Searches, sum(PCDS) AS Previous_Searches,
         sum(DSC) AS Search_Change FROM dest_days GROUP BY ALL
),
k_h AS (
  SELECT checkin_date, count(DISTINCT ProductID) AS Active_Hotels,
         count_if(coalesce(View_Change > 0, FALSE)) AS Rising_Hotels, count_if(Action) AS Action_Hotels
  FROM hsig GROUP BY ALL
),
k_o AS (SELECT checkin_date, coalesce(sum(Total_Observed_Searches), 0.0) AS Total_Observed_Searches
        FROM hist_d GROUP BY ALL),
kp0 AS (
  SELECT d.*, h.Active_Hotels, h.Rising_Hotels, h.Action_Hotels,
         coalesce(o.Total_Observed_Searches, 0.0) AS Total_Observed_Searches,
         CAST(floor(coalesce(o.Total_Observed_Searches, 0.0) + 0.5) AS BIGINT) AS Total_Observed_Searches_Display,
         y."Demand Level",
         CASE WHEN d.Previous_Searches <> 0 AND d.Search_Change IS NOT NULL
              THEN d.Search_Change / d.Previous_Searches END AS Change_Pct
  FROM k_dest d JOIN k_h h USING (checkin_date) LEFT JOIN k_o o USING (checkin_date)
  LEFT JOIN daily y USING (checkin_date)
),
kpis AS (
  SELECT *, CASE WHEN Change_Pct IS NULL THEN 'No baseline' WHEN Change_Pct >= 0.25 THEN 'Critical surge'
                 WHEN Change_Pct >= 0.10 THEN 'High increase' WHEN Change_Pct <= -0.10 THEN 'Declining'
                 ELSE 'Stable' END AS Date_Signal
  FROM kp0
)"""


@register("daily_kpis", KPI_SQL + _sel(KPI_COLS, ["Latest_Window_Searches", "Previous_Searches", "Search_Change",
                                                   "Total_Observed_Searches", "Change_Pct"], "kpis"))
def q_daily_kpis(spark, sf_dir):
    """F14 + W10 + W11: the daily KPI row for every check-in date."""
    r = _rebuild(spark, sf_dir)
    detail = _detail(r)
    return V.daily_kpis(detail, r.history[1], V.daily_market(detail)).select(*[F.col(f"`{c}`") for c in KPI_COLS])


HDAY_SQL = FULL + """,
hd_s AS (SELECT checkin_date, sum(Total_Observed_Searches) AS Searches FROM hist_d GROUP BY ALL),
hd_v AS (SELECT checkin_date, sum(Total_Observed_Views) AS Views, count(DISTINCT ProductID) AS Hotels
         FROM hist_h GROUP BY ALL),
hday0 AS (SELECT * FROM hd_s FULL OUTER JOIN hd_v USING (checkin_date)),
hday_q AS (SELECT quantile_cont(Searches, [0.4, 0.75, 0.9]) AS q FROM hday0),
hday AS (
  SELECT hday0.*, CASE WHEN Searches >= q[3] THEN 'Very High' WHEN Searches >= q[2] THEN 'High'
                       WHEN Searches >= q[1] THEN 'Medium' ELSE 'Low' END AS "Demand Level"
  FROM hday0, hday_q
)"""
HDAY_COLS = ["checkin_date", "Searches", "Views", "Hotels", "Demand Level"]


@register("history_daily", HDAY_SQL + _sel(HDAY_COLS, ["Searches", "Views"], "hday"))
def q_history_daily(spark, sf_dir):
    """A12 + W3: stored searches, views, hotels and level per check-in date."""
    r = _rebuild(spark, sf_dir)
    return V.history_daily(*r.history)


@register("strongest_dates", HDAY_SQL + _sel(HDAY_COLS, ["Searches", "Views"],
          "(SELECT * FROM hday ORDER BY Searches DESC NULLS LAST, checkin_date ASC LIMIT 5)"))
def q_strongest_dates(spark, sf_dir):
    """The five strongest stored check-in dates."""
    r = _rebuild(spark, sf_dir)
    return V.strongest_dates(V.history_daily(*r.history))


MAP_SQL = FULL + """,
coords AS (
  SELECT n_name AS Destination, CAST(n_nationkey * 0.5 + 5.0 AS DOUBLE) AS Latitude,
         CAST(n_regionkey * 2.0 + 98.0 AS DOUBLE) AS Longitude FROM nation
),
mp_v AS (SELECT checkin_date, Destination, sum(Total_Observed_Views) AS Views FROM hist_h GROUP BY ALL),
mp0 AS (
  SELECT checkin_date, Destination, coalesce(s.Total_Observed_Searches, 0.0) AS Searches,
         coalesce(v.Views, 0.0) AS Views, c.Latitude, c.Longitude
  FROM (SELECT checkin_date, Destination, Total_Observed_Searches FROM hist_d) s
  FULL OUTER JOIN mp_v v USING (checkin_date, Destination)
  JOIN coords c USING (Destination)
),
mp_q AS (
  SELECT checkin_date, quantile_cont(CASE WHEN Searches > 0 THEN Searches END, [0.2, 0.5, 0.75, 0.9]) AS q
  FROM mp0 GROUP BY ALL
),
mp AS (
  SELECT m.*, CASE WHEN Searches >= coalesce(q[4], 0) THEN 'Very High' WHEN Searches >= coalesce(q[3], 0) THEN 'High'
                   WHEN Searches >= coalesce(q[2], 0) THEN 'Medium' WHEN Searches >= coalesce(q[1], 0) THEN 'Low'
                   ELSE 'Very Low' END AS "Demand Level"
  FROM mp0 m LEFT JOIN mp_q USING (checkin_date)
)"""
MAP_COLS = ["checkin_date", "Destination", "Searches", "Views", "Latitude", "Longitude", "Demand Level"]


@register("map_table", MAP_SQL + _sel(MAP_COLS, ["Searches", "Views", "Latitude", "Longitude"], "mp"))
def q_map_table(spark, sf_dir):
    """A13 + W5: mapped destination demand and level per check-in date."""
    r = _rebuild(spark, sf_dir)
    coords = T.destination_coordinates(spark, sf_dir)
    return V.map_table(*r.history, coords).select(*MAP_COLS)


WL_COLS = ["checkin_date", "Priority", "ProductID", "ProductName", "Region", "Destination", "Total_Observed_Views",
           "View Change %", "View_Change", "Hotel Signal", "Destination Signal", "Demand Level",
           "Why prioritized", "Work Priority"]
WL_SQL = FULL + f""",
wl_recent AS (
  SELECT checkin_date, ProductID, "View Change %", View_Change, "Hotel Signal", "Destination Signal", Region
  FROM hsig
),
wl0 AS (
  SELECT h.*, r."View Change %", r.View_Change,
         coalesce(r."Hotel Signal", 'No recent observation') AS "Hotel Signal",
         coalesce(r."Destination Signal", 'No recent observation') AS "Destination Signal", r.Region
  FROM hist_h h LEFT JOIN wl_recent r USING (checkin_date, ProductID)
),
wl1 AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY checkin_date ORDER BY Total_Observed_Views DESC NULLS LAST,
             View_Change DESC NULLS LAST, ProductName ASC NULLS LAST, ProductID) AS Priority
    FROM wl0) WHERE Priority <= 12
),
wl_q AS (SELECT checkin_date, quantile_cont(Total_Observed_Views, [0.5, 0.8]) AS q FROM hist_h GROUP BY ALL),
wl2 AS (
  SELECT w.*, q.q,
    CASE WHEN Total_Observed_Views >= q[2] THEN 'Very High' WHEN Total_Observed_Views >= q[1] THEN 'High'
         ELSE 'Medium' END AS "Demand Level"
  FROM wl1 w LEFT JOIN wl_q q USING (checkin_date)
),
wl AS (
  SELECT *,
    CASE WHEN "Destination Signal" IN ('Critical surge', 'High increase') AND coalesce(View_Change > 0, FALSE)
           THEN 'Destination rising + hotel views rising'
         WHEN "Demand Level" = 'Very High' THEN 'High hotel views'
         ELSE 'Hotel interest to monitor' END AS "Why prioritized",
    CASE WHEN coalesce(Total_Observed_Views > 0 AND Total_Observed_Views >= q[2], FALSE)
              AND coalesce(View_Change > 0, FALSE) THEN '{V.WORK_PRIORITY[0]}'
         WHEN coalesce(Total_Observed_Views > 0 AND Total_Observed_Views >= q[2], FALSE) THEN '{V.WORK_PRIORITY[1]}'
         WHEN coalesce(View_Change > 0, FALSE) THEN '{V.WORK_PRIORITY[2]}'
         ELSE '{V.WORK_PRIORITY[3]}' END AS "Work Priority"
  FROM wl2
)"""


@register("date_worklist", WL_SQL + _sel(WL_COLS, ["Total_Observed_Views", "View Change %", "View_Change"], "wl"))
def q_date_worklist(spark, sf_dir):
    """W14 + W4 + W12: the twelve hotels to check for every check-in date."""
    r = _rebuild(spark, sf_dir)
    return V.date_worklist(r.history[0], _detail(r)).select(*[F.col(f"`{c}`") for c in WL_COLS])


ENG = O.with_ctes(*O.funnel_sql(300), O.SUMMARY, O.ENGINE)


@register("portfolio_kpis", ENG + """ SELECT count(*) AS Hotels, count_if(Priority = 'Critical') AS Critical,
  count_if(Priority = 'High') AS High, round(sum(Revenue), 9) + 0.0 AS Revenue,
  round(round_even(avg("Opportunity Index") * 10, 0) / 10, 9) + 0.0 AS Avg_Opportunity FROM engine""")
def q_portfolio_kpis(spark, sf_dir):
    """Portfolio counters over the engine."""
    return V.portfolio_kpis(_rebuild(spark, sf_dir).engine)


@register("priority_counts", ENG + " SELECT Priority, count(*) AS count FROM engine GROUP BY ALL")
def q_priority_counts(spark, sf_dir):
    """Hotels per priority band."""
    return V.priority_counts(_rebuild(spark, sf_dir).engine)


@register("engine_validation", ENG + """ SELECT count(*) AS Rows, count(DISTINCT ProductID) AS Unique_ProductIDs,
  count(*) = count(DISTINCT ProductID) AS No_Duplicates FROM engine""")
def q_engine_validation(spark, sf_dir):
    """Engine rows against distinct hotels."""
    return V.engine_validation(_rebuild(spark, sf_dir).engine)


V2_COLS = ["ProductID", "Revenue Score v2", "RN Score v2", "Mapping Score v2", "Business Score v2",
           "Opportunity Score v2"]
V2_SQL = ENG + """,
v2a AS (SELECT max(Revenue) AS mr, max("B2B2C RN") AS mn FROM engine),
v2b AS (
  SELECT ProductID, Demand_Score,
    round_even((CASE WHEN mr <> 0 THEN Revenue / mr END) * 100 * 100, 0) / 100 AS "Revenue Score v2",
    round_even((CASE WHEN mn <> 0 THEN "B2B2C RN" / mn END) * 100 * 100, 0) / 100 AS "RN Score v2",
    CAST((CASE WHEN "Agoda Status" = 'Mapped' THEN 50 ELSE 0 END)
         + (CASE WHEN "Ctrip Status" = 'Mapped' THEN 50 ELSE 0 END) AS BIGINT) AS "Mapping Score v2"
  FROM engine, v2a
),
v2c AS (
  SELECT *, round_even(("Revenue Score v2" * 0.5 + "RN Score v2" * 0.3 + Demand_Score * 0.2) * 100, 0) / 100
    AS "Business Score v2" FROM v2b
),
v2 AS (
  SELECT *, round_even(("Business Score v2" * (100 - "Mapping Score v2") / 100) * 100, 0) / 100
    AS "Opportunity Score v2" FROM v2c
)"""


@register("scores_v2", V2_SQL + _sel(V2_COLS, ["Revenue Score v2", "RN Score v2", "Business Score v2",
                                               "Opportunity Score v2"], "v2"))
def q_scores_v2(spark, sf_dir):
    """The older score set."""
    return E.scores_v2(_rebuild(spark, sf_dir).engine).select(*[F.col(f"`{c}`") for c in V2_COLS])


@register("hotel_summary_text", ENG + f""" SELECT ProductID, concat_ws(' ',
  CASE WHEN Priority = 'Critical' THEN '{E.SUMMARY_SENTENCES[0]}' END,
  CASE WHEN Demand_Score > 70 THEN '{E.SUMMARY_SENTENCES[1]}' END,
  CASE WHEN "Agoda Status" <> 'Mapped' THEN '{E.SUMMARY_SENTENCES[2]}' END,
  CASE WHEN Revenue > 500000 THEN '{E.SUMMARY_SENTENCES[3]}' END,
  'Recommended action: ' || Action || '.') AS Summary FROM engine""")
def q_hotel_summary_text(spark, sf_dir):
    """PRJ8: one text summary per hotel."""
    e = _rebuild(spark, sf_dir).engine
    return e.select("ProductID", E.hotel_summary_text(e).alias("Summary"))


@register("hotel_master_view", O.with_ctes(O.ENGINE.split("roll AS (")[0].rstrip().rstrip(","), """
p_raw AS (
  SELECT ProductID, "Agoda Status", "Ctrip Status" FROM (
    SELECT o_custkey AS ProductID, """ + O.AGODA_CASE + """ AS "Agoda Status", """ + O.CTRIP_CASE + """ AS "Ctrip Status",
           row_number() OVER (PARTITION BY o_custkey ORDER BY (o_totalprice IS NULL) DESC, o_totalprice DESC,
             ((o_orderkey % 40) IS NULL) DESC, o_orderkey % 40 DESC, o_orderkey DESC) AS rk
    FROM orders) WHERE rk = 1
)""") + """ SELECT m.ProductID, m.ProductName, m.Destination, m."HotelType Short", m.Region,
  p."Agoda Status", p."Ctrip Status" FROM m1 m LEFT JOIN p_raw p USING (ProductID)""")
def q_hotel_master_view(spark, sf_dir):
    """D3: deduplicated master with partner statuses."""
    return E.hotel_master_view(T.hotel_master(spark, sf_dir), T.hotel_performance(spark, sf_dir))


# ---------------------------------------------------------------- weeks and trends (bulk form)

from staylens.operators import weeks as W  # noqa: E402


def _raw_latest(spark, sf_dir):
    """PRJ3: the light load (no row dropped) used by the comparison views."""
    return clean.load_demand(T.demand_latest(spark, sf_dir))


RAW = [O.DEMAND_ROWS, O.LATEST]
WK_OPTS = """
wk_opts AS (
  SELECT DISTINCT CAST(date_trunc('week', snapshot_at) AS DATE) AS week_start
  FROM latest_raw WHERE snapshot_at IS NOT NULL
)"""


@register("week_options", O.with_ctes(*RAW, WK_OPTS) + """ SELECT week_start,
  CAST(isoyear(week_start) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(week_start) AS VARCHAR), 2, '0')
  || ' (' || strftime(week_start, '%d %b') || '–' || strftime(week_start + 6, '%d %b') || ')' AS label
  FROM wk_opts""")
def q_week_options(spark, sf_dir):
    """ISO snapshot weeks with labels."""
    return W.week_options(_raw_latest(spark, sf_dir))


@register("snapshot_freshness", O.with_ctes(*RAW) + """ SELECT CAST(date_trunc('week', snapshot_at) AS DATE)
  AS week_start, max(snapshot_at) AS Latest_Snapshot, count(*) AS Rows FROM latest_raw
  WHERE snapshot_at IS NOT NULL GROUP BY ALL""")
def q_snapshot_freshness(spark, sf_dir):
    """F16: newest snapshot per ISO snapshot week."""
    return W.snapshot_freshness(_raw_latest(spark, sf_dir))


SW_COLS = [
    "week_start", "ProductID", "checkin_date", "view_volume", "Interval_Count", "hotness_score", "trend_momentum",
    "ProductName", "Destination", "snapshot_at", "check_status", "Previous_Views", "Previous_View_Intervals",
    "Comparable_View_Intervals", "Comparable_Views", "Previous_Comparable_Views", "View_Change",
    "Destination_Searches", "Destination_Search_Snapshot", "Destination_Intervals", "Previous_Destination_Searches",
    "Previous_Destination_Intervals", "Comparable_Destination_Intervals", "Comparable_Destination_Searches",
    "Previous_Comparable_Destination_Searches", "Previous_Destination_Search_Snapshot", "Destination_Search_Change",
    "Upload_Change_Status",
]
SW_DOUBLES = ["view_volume", "hotness_score", "trend_momentum", "Previous_Views", "Comparable_Views",
              "Previous_Comparable_Views", "View_Change", "Destination_Searches", "Previous_Destination_Searches",
              "Comparable_Destination_Searches", "Previous_Comparable_Destination_Searches",
              "Destination_Search_Change"]
SW_SQL = O.with_ctes(*RAW, WK_OPTS, """
sw_rows AS (
  SELECT * REPLACE (coalesce(view_volume, 0.0) AS view_volume,
                    coalesce(lower(trim(check_status)), 'unknown') AS check_status)
  FROM latest_raw WHERE snapshot_at IS NOT NULL AND checkin_date IS NOT NULL
),
sw_rel AS (
  SELECT r.*, w.week_start,
         CASE WHEN r.snapshot_at >= w.week_start THEN 'latest' ELSE 'previous' END AS period
  FROM sw_rows r JOIN wk_opts w
    ON r.snapshot_at >= w.week_start - INTERVAL 7 DAY AND r.snapshot_at < w.week_start + INTERVAL 7 DAY
)""", O.batched("sw_rel", "swb", 300, scope="week_start"),
    O.keep_last("swb", "sw_iv", "week_start, period, Observation_Batch, ProductID, checkin_date",
                where="ProductID IS NOT NULL"), """
sw_l AS (
  SELECT week_start, ProductID, checkin_date, coalesce(sum(view_volume), 0.0) AS view_volume,
         count(*) AS Interval_Count, avg(hotness_score) AS hotness_score, avg(trend_momentum) AS trend_momentum,
         arg_max_null(ProductName, snapshot_at) AS ProductName, arg_max_null(Destination, snapshot_at) AS Destination,
         max(snapshot_at) AS snapshot_at, arg_max_null(check_status, snapshot_at) AS check_status
  FROM sw_iv WHERE period = 'latest' GROUP BY ALL
),
sw_p AS (
  SELECT week_start, ProductID, checkin_date, coalesce(sum(view_volume), 0.0) AS Previous_Views,
         count(*) AS Previous_View_Intervals
  FROM sw_iv WHERE period = 'previous' GROUP BY ALL
),
sw_h AS (
  SELECT l.*, p.Previous_Views, p.Previous_View_Intervals,
         CASE WHEN p.Previous_View_Intervals IS NOT NULL THEN least(l.Interval_Count, p.Previous_View_Intervals) END
           AS Comparable_View_Intervals
  FROM sw_l l LEFT JOIN sw_p p USING (week_start, ProductID, checkin_date)
),
sw_h2 AS (
  SELECT *, view_volume / Interval_Count * Comparable_View_Intervals AS Comparable_Views,
         Previous_Views / Previous_View_Intervals * Comparable_View_Intervals AS Previous_Comparable_Views
  FROM sw_h
),
sw_di AS (
  SELECT week_start, period, Observation_Batch, Destination, checkin_date,
         median(search_volume) AS search_volume, max(snapshot_at) AS snapshot_at
  FROM swb WHERE Destination IS NOT NULL GROUP BY ALL
),
sw_dl AS (
  SELECT week_start, Destination, checkin_date, coalesce(sum(search_volume), 0.0) AS Destination_Searches,
         max(snapshot_at) AS Destination_Search_Snapshot, count(*) AS Destination_Intervals
  FROM sw_di WHERE period = 'latest' GROUP BY ALL
),
sw_dp AS (
  SELECT week_start, Destination, checkin_date, coalesce(sum(search_volume), 0.0) AS Previous_Destination_Searches,
         count(*) AS Previous_Destination_Intervals
  FROM sw_di WHERE period = 'previous' GROUP BY ALL
),
sw_d AS (
  SELECT l.*, p.Previous_Destination_Searches, p.Previous_Destination_Intervals,
         CASE WHEN p.Previous_Destination_Intervals IS NOT NULL
              THEN least(l.Destination_Intervals, p.Previous_Destination_Intervals) END
           AS Comparable_Destination_Intervals,
         CAST(l.week_start AS TIMESTAMP) - INTERVAL 1 SECOND AS Previous_Destination_Search_Snapshot
  FROM sw_dl l LEFT JOIN sw_dp p USING (week_start, Destination, checkin_date)
),
sw_d2 AS (
  SELECT *, Destination_Searches / Destination_Intervals * Comparable_Destination_Intervals
              AS Comparable_Destination_Searches,
         Previous_Destination_Searches / Previous_Destination_Intervals * Comparable_Destination_Intervals
              AS Previous_Comparable_Destination_Searches
  FROM sw_d
),
sw AS (
  SELECT h.*, h.Comparable_Views - h.Previous_Comparable_Views AS View_Change,
         d.Destination_Searches, d.Destination_Search_Snapshot, d.Destination_Intervals,
         d.Previous_Destination_Searches, d.Previous_Destination_Intervals, d.Comparable_Destination_Intervals,
         d.Comparable_Destination_Searches, d.Previous_Comparable_Destination_Searches,
         d.Previous_Destination_Search_Snapshot,
         d.Comparable_Destination_Searches - d.Previous_Comparable_Destination_Searches AS Destination_Search_Change,
         CASE WHEN h.Previous_Views IS NULL THEN 'New'
              WHEN h.Comparable_Views - h.Previous_Comparable_Views > 0 THEN 'Increase'
              WHEN h.Comparable_Views - h.Previous_Comparable_Views < 0 THEN 'Decrease'
              ELSE 'No change' END AS Upload_Change_Status
  FROM sw_h2 h LEFT JOIN sw_d2 d
    ON h.week_start = d.week_start AND h.Destination = d.Destination AND h.checkin_date = d.checkin_date
)""")


@register("snapshot_week", SW_SQL + _sel(SW_COLS, SW_DOUBLES, "sw"))
def q_snapshot_week(spark, sf_dir):
    """every ISO snapshot week against the previous week."""
    return W.snapshot_week(_raw_latest(spark, sf_dir), 300).select(*SW_COLS)


FULL_HIST = [f"""
fh_rows AS (
  SELECT * REPLACE (coalesce(view_volume, 0.0) AS view_volume, coalesce(lower(trim(check_status)), 'unknown') AS check_status) FROM latest_raw
  WHERE snapshot_at IS NOT NULL AND checkin_date IS NOT NULL AND ProductID IS NOT NULL AND Destination IS NOT NULL
)""", O.batched("fh_rows", "fhb", 300), O.hotel_checkin("fhb", "fhh"), """
fhd_pb AS (
  SELECT Observation_Batch, Destination, checkin_date, median(search_volume) AS s, max(snapshot_at) AS t
  FROM fhb GROUP BY ALL
),
fhd AS (
  SELECT Destination, checkin_date, coalesce(sum(s), 0.0) AS Destination_Searches,
         max(t) AS Destination_Search_Snapshot, count(*) AS Destination_Intervals
  FROM fhd_pb GROUP BY ALL
),
full_hist AS (
  SELECT h.* EXCLUDE (search_volume), d.Destination_Searches, d.Destination_Search_Snapshot, d.Destination_Intervals
  FROM fhh h LEFT JOIN fhd d USING (Destination, checkin_date)
)"""]
FH_COLS = ["ProductID", "checkin_date", "snapshot_at", "hotness_score", "trend_momentum", "view_volume",
           "Interval_Count", "ProductName", "Destination", "check_status", "Destination_Searches",
           "Destination_Search_Snapshot", "Destination_Intervals"]


@register("full_history_funnel", O.with_ctes(*RAW, *FULL_HIST)
          + _sel(FH_COLS, ["hotness_score", "trend_momentum", "view_volume", "Destination_Searches"], "full_hist"))
def q_full_history_funnel(spark, sf_dir):
    """A10: hotel x check-in facts over every stored row, with destination searches."""
    return facts.full_history_funnel(_raw_latest(spark, sf_dir), 300).select(*FH_COLS)


@register("checkin_date_trend", O.with_ctes(*RAW, """
t_rows AS (
  SELECT * REPLACE (coalesce(view_volume, 0.0) AS view_volume) FROM latest_raw
  WHERE snapshot_at IS NOT NULL AND checkin_date IS NOT NULL AND Destination IS NOT NULL
)""", O.batched("t_rows", "tb", 300), O.destination_checkin("tb", "td"),
    O.keep_last("tb", "t_iv", "Observation_Batch, ProductID, checkin_date", where="ProductID IS NOT NULL"), """
t_v AS (SELECT Destination, checkin_date, coalesce(sum(view_volume), 0.0) AS Views FROM t_iv GROUP BY ALL),
trend AS (
  SELECT * FROM (SELECT Destination, checkin_date, Destination_Searches AS Searches FROM td)
  FULL OUTER JOIN t_v USING (Destination, checkin_date)
)""") + _sel(["Destination", "checkin_date", "Searches", "Views"], ["Searches", "Views"], "trend"))
def q_checkin_date_trend(spark, sf_dir):
    """Destination x check-in searches and views over all stored rows."""
    return facts.checkin_date_trend(_raw_latest(spark, sf_dir), 300)


@register("hotel_trend", O.with_ctes(*RAW, O.batched("latest_raw", "ab", 300), """
a_rows AS (
  SELECT * REPLACE (coalesce(view_volume, 0.0) AS view_volume, coalesce(search_volume, 0.0) AS search_volume)
  FROM ab WHERE checkin_date IS NOT NULL
),""".rstrip(","), O.keep_last("a_rows", "a_iv", "Observation_Batch, ProductID, checkin_date",
                               where="ProductID IS NOT NULL"), """
a_views AS (SELECT ProductID, checkin_date, coalesce(sum(view_volume), 0.0) AS "Hotel Views"
            FROM a_iv GROUP BY ALL),
a_home AS (
  SELECT ProductID, arg_max(Destination, load_seq * 1000000000000 + row_seq) AS Destination
  FROM a_rows WHERE ProductID IS NOT NULL AND Destination IS NOT NULL GROUP BY ALL
),
a_ds AS (
  SELECT Destination, checkin_date, sum(s) AS "Destination Searches" FROM (
    SELECT Observation_Batch, Destination, checkin_date, median(search_volume) AS s
    FROM a_rows WHERE Destination IS NOT NULL GROUP BY ALL) GROUP BY ALL
),
a_hd AS (SELECT h.ProductID, d.checkin_date, d."Destination Searches" FROM a_home h JOIN a_ds d USING (Destination)),
a_trend AS (SELECT * FROM a_hd FULL OUTER JOIN a_views USING (ProductID, checkin_date))""")
    + _sel(["ProductID", "checkin_date", "Destination Searches", "Hotel Views"],
           ["Destination Searches", "Hotel Views"], "a_trend"))
def q_hotel_trend(spark, sf_dir):
    """A11 (bulk): every hotel's views and its destination's searches per check-in date."""
    return facts.hotel_trend(_raw_latest(spark, sf_dir), 300)


@register("daily_history_trend", O.with_ctes(*O.funnel_sql(300)[:3], *O.history_sql(300)) + """ SELECT
  checkin_date, round(s.Searches, 9) + 0.0 AS Searches, round(v.Views, 9) + 0.0 AS Views FROM
  (SELECT checkin_date, sum(Total_Observed_Searches) AS Searches FROM hist_d GROUP BY ALL) s
  FULL OUTER JOIN (SELECT checkin_date, sum(Total_Observed_Views) AS Views FROM hist_h GROUP BY ALL) v
  USING (checkin_date)""")
def q_daily_history_trend(spark, sf_dir):
    """Stored searches and views per check-in date."""
    hotels, destinations = facts.stored_history(latest(spark, sf_dir), previous(spark, sf_dir))
    return facts.daily_history_trend(hotels, destinations)


# ---------------------------------------------------------------- check-in weeks (bulk form)

def _checkin_detail(spark, sf_dir):
    r = _rebuild(spark, sf_dir)
    detail = W.checkin_detail(facts.full_history_funnel(_raw_latest(spark, sf_dir), 300), r.engine)
    # read by several branches (destinations, hotels, daily): written once
    return cut_lineage(detail, "checkin_detail")


def _order_case(col: str, table: dict) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


def _signal_case(pct: str) -> str:
    return (f"CASE WHEN {pct} >= 0.25 THEN 'Critical surge' WHEN {pct} >= 0.10 THEN 'High increase' "
            f"WHEN {pct} <= -0.10 THEN 'Declining' ELSE 'Stable' END")


CI_SQL = O.with_ctes(*O.full_chain(300), *FULL_HIST, f"""
ci_detail AS (
  SELECT f.* REPLACE (coalesce(f.Destination_Searches, 0.0) AS Destination_Searches), e.Region, e."HotelType Short"
  FROM full_hist f JOIN (SELECT ProductID, Region, "HotelType Short" FROM engine) e USING (ProductID)
  WHERE f.checkin_date IS NOT NULL
),
ci_weeks AS (SELECT DISTINCT CAST(date_trunc('week', checkin_date) AS DATE) AS week_start FROM ci_detail),
ci_rel AS (
  SELECT d.*, w.week_start, CASE WHEN d.checkin_date >= w.week_start THEN 'current' ELSE 'previous' END AS period
  FROM ci_detail d JOIN ci_weeks w
    ON d.checkin_date >= w.week_start - INTERVAL 7 DAY AND d.checkin_date < w.week_start + INTERVAL 7 DAY
),
ci_dd AS (
  SELECT week_start, period, Destination, checkin_date, max(Destination_Searches) AS s
  FROM ci_rel WHERE Destination IS NOT NULL GROUP BY ALL
),
ci_dc AS (SELECT week_start, Destination, sum(s) AS Current_Searches FROM ci_dd WHERE period = 'current' GROUP BY ALL),
ci_dp AS (SELECT week_start, Destination, sum(s) AS Previous_Searches FROM ci_dd WHERE period = 'previous' GROUP BY ALL),
ci_dest0 AS (
  SELECT week_start, Destination, coalesce(Current_Searches, 0.0) AS Current_Searches,
         coalesce(Previous_Searches, 0.0) AS Previous_Searches
  FROM ci_dc FULL OUTER JOIN ci_dp USING (week_start, Destination)
),
ci_dest AS (
  SELECT *, Current_Searches - Previous_Searches AS Search_Change,
         CASE WHEN Previous_Searches > 0 THEN (Current_Searches - Previous_Searches) / Previous_Searches END
           AS Change_Pct
  FROM ci_dest0
),
ci_hc AS (
  SELECT week_start, ProductID,
         arg_max(ProductName, checkin_date) FILTER (WHERE ProductName IS NOT NULL) AS ProductName,
         arg_max(Destination, checkin_date) FILTER (WHERE Destination IS NOT NULL) AS Destination,
         coalesce(sum(view_volume), 0.0) AS Current_Views, count(DISTINCT checkin_date) AS CheckIn_Days,
         max(Region) AS Region
  FROM ci_rel WHERE period = 'current' GROUP BY ALL
),
ci_hp AS (
  SELECT week_start, ProductID, coalesce(sum(view_volume), 0.0) AS Previous_Views
  FROM ci_rel WHERE period = 'previous' GROUP BY ALL
),
ci_h0 AS (
  SELECT c.*, p.Previous_Views, c.Current_Views - p.Previous_Views AS View_Change,
         CASE WHEN p.Previous_Views > 0 THEN (c.Current_Views - p.Previous_Views) / p.Previous_Views END
           AS View_Change_Pct
  FROM ci_hc c LEFT JOIN ci_hp p USING (week_start, ProductID)
),
ci_h1 AS (
  SELECT h.*, d.Current_Searches, d.Previous_Searches, d.Search_Change, d.Change_Pct
  FROM ci_h0 h LEFT JOIN ci_dest d ON h.week_start = d.week_start AND h.Destination = d.Destination
),
ci_h2 AS (
  SELECT *,
    CASE WHEN coalesce(Previous_Searches = 0 AND Current_Searches > 0, FALSE) THEN 'New demand'
         ELSE {_signal_case('Change_Pct')} END AS "Destination Signal",
    CASE WHEN Previous_Views IS NULL THEN 'New interest' ELSE {_signal_case('View_Change_Pct')} END AS "Hotel Signal"
  FROM ci_h1
),
ci_hq AS (SELECT week_start, quantile_cont(Current_Views, [0.75, 0.8]) AS q FROM ci_h2 GROUP BY ALL),
ci_hotels AS (
  SELECT h.* ,
    coalesce("Destination Signal" IN ('Critical surge', 'High increase', 'New demand')
      AND (coalesce(View_Change > 0, FALSE) OR coalesce(Current_Views >= q[1], FALSE)), FALSE) AS Action,
    CASE WHEN coalesce(Current_Views > 0 AND Current_Views >= q[2], FALSE) AND coalesce(View_Change > 0, FALSE)
           THEN '{V.WORK_PRIORITY[0]}'
         WHEN coalesce(Current_Views > 0 AND Current_Views >= q[2], FALSE) THEN '{V.WORK_PRIORITY[1]}'
         WHEN coalesce(View_Change > 0, FALSE) THEN '{V.WORK_PRIORITY[2]}'
         ELSE '{V.WORK_PRIORITY[3]}' END AS "Work Priority",
    row_number() OVER (PARTITION BY week_start ORDER BY (Current_Views > 0) DESC, Current_Views DESC NULLS LAST,
      {_order_case('"Hotel Signal"', W.HOTEL_SIGNAL_ORDER)} DESC,
      {_order_case('"Destination Signal"', W.DEST_SIGNAL_ORDER)} DESC,
      View_Change DESC NULLS LAST, ProductID) AS Priority
  FROM ci_h2 h JOIN ci_hq USING (week_start)
),
ci_ds AS (
  SELECT week_start, period, checkin_date, sum(s) AS Searches FROM (
    SELECT week_start, period, checkin_date, Destination, max(Destination_Searches) AS s FROM ci_rel GROUP BY ALL
  ) GROUP BY ALL
),
ci_dv AS (SELECT week_start, period, checkin_date, sum(view_volume) AS Views FROM ci_rel GROUP BY ALL),
ci_daily AS (
  SELECT week_start, checkin_date, Searches, Views,
         checkin_date + CASE WHEN period = 'previous' THEN 7 ELSE 0 END AS Matched_Date,
         CASE WHEN period = 'current' THEN 'Selected week' ELSE 'Previous week' END AS Period,
         strftime(checkin_date + CASE WHEN period = 'previous' THEN 7 ELSE 0 END, '%a') AS Weekday
  FROM ci_ds FULL OUTER JOIN ci_dv USING (week_start, period, checkin_date)
)""")

CI_HOTEL_COLS = ["week_start", "ProductID", "ProductName", "Destination", "Region", "Current_Views", "CheckIn_Days",
                 "Previous_Views", "View_Change", "View_Change_Pct", "Current_Searches", "Previous_Searches",
                 "Search_Change", "Change_Pct", "Destination Signal", "Hotel Signal", "Action", "Work Priority",
                 "Priority"]
CI_HOTEL_DOUBLES = ["Current_Views", "Previous_Views", "View_Change", "View_Change_Pct", "Current_Searches",
                    "Previous_Searches", "Search_Change", "Change_Pct"]


@register("checkin_week_hotels", CI_SQL + _sel(CI_HOTEL_COLS, CI_HOTEL_DOUBLES, "ci_hotels"))
def q_checkin_week_hotels(spark, sf_dir):
    """F8 + W7 + W9 + W11-W13: hotels of every check-in week against the week before, ranked."""
    return W.checkin_week_hotels(_checkin_detail(spark, sf_dir)).select(*[F.col(f"`{c}`") for c in CI_HOTEL_COLS])


@register("week_worklist", CI_SQL + _sel(CI_HOTEL_COLS, CI_HOTEL_DOUBLES,
                                         "(SELECT * FROM ci_hotels WHERE Priority <= 200)"))
def q_week_worklist(spark, sf_dir):
    """The first 200 hotels of every check-in week."""
    return W.week_worklist(_checkin_detail(spark, sf_dir)).select(*[F.col(f"`{c}`") for c in CI_HOTEL_COLS])


WIDE_SQL = """WITH ci_detail AS (
  SELECT o_custkey AS ProductID, DATE '2024-01-01' + CAST(o_orderkey % 28 AS INT) AS checkin_date,
         'Hotel ' || o_custkey AS ProductName, n_name AS Destination, 'Region ' || (o_custkey % 5) AS Region,
         sum(floor(o_totalprice)) AS view_volume, CAST(n_nationkey * 10 + o_orderkey % 28 % 7 AS DOUBLE) AS Destination_Searches
  FROM orders JOIN nation ON n_nationkey = o_custkey % 25 GROUP BY ALL
),
ci_weeks AS (""" + CI_SQL.split("ci_weeks AS (", 1)[1]


@register("week_worklist_orders", WIDE_SQL + _sel(CI_HOTEL_COLS, CI_HOTEL_DOUBLES,
                                                  "(SELECT * FROM ci_hotels WHERE Priority <= 200)"))
def q_week_worklist_orders(spark, sf_dir):
    """W13 where every week has more than 200 hotels: customers as hotels, order prices as views."""
    day = (F.col("o_orderkey") % 28).cast("int")
    orders = T.table(spark, sf_dir, "orders").join(
        F.broadcast(T.table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("o_custkey") % 25  # 25 rows
    )
    detail = orders.groupBy(
        F.col("o_custkey").alias("ProductID"), F.date_add(F.lit("2024-01-01").cast("date"), day).alias("checkin_date"),
        F.concat(F.lit("Hotel "), F.col("o_custkey").cast("string")).alias("ProductName"), F.col("n_name").alias("Destination"),
        F.concat(F.lit("Region "), (F.col("o_custkey") % 5).cast("string")).alias("Region"),
        (F.col("n_nationkey") * 10 + day % 7).cast("double").alias("Destination_Searches"),
    ).agg(F.sum(F.floor("o_totalprice")).cast("double").alias("view_volume"))
    return W.week_worklist(cut_lineage(detail, "orders_detail")).select(*[F.col(f"`{c}`") for c in CI_HOTEL_COLS])


CI_DEST_COLS = ["week_start", "Destination", "Current_Searches", "Previous_Searches", "Search_Change", "Change_Pct"]


@register("checkin_week_destinations", CI_SQL + _sel(CI_DEST_COLS, CI_DEST_COLS[2:], "ci_dest"))
def q_checkin_week_destinations(spark, sf_dir):
    """destination searches of every check-in week against the week before."""
    return W.checkin_week_destinations(_checkin_detail(spark, sf_dir)).select(*CI_DEST_COLS)


CI_DAILY_COLS = ["week_start", "checkin_date", "Searches", "Views", "Matched_Date", "Period", "Weekday"]


@register("checkin_week_daily", CI_SQL + _sel(CI_DAILY_COLS, ["Searches", "Views"], "ci_daily"))
def q_checkin_week_daily(spark, sf_dir):
    """per check-in week and date, searches and views of both weeks aligned by weekday."""
    return W.checkin_week_daily(_checkin_detail(spark, sf_dir)).select(*CI_DAILY_COLS)


@register("unpivot_trend", CI_SQL + """,
ci_long AS (
  SELECT week_start, checkin_date, Matched_Date, Period, Weekday, 'Searches' AS Metric, Searches AS Volume FROM ci_daily
  UNION ALL
  SELECT week_start, checkin_date, Matched_Date, Period, Weekday, 'Views' AS Metric, Views AS Volume FROM ci_daily
)""" + _sel(["week_start", "checkin_date", "Matched_Date", "Period", "Weekday", "Metric", "Volume"], ["Volume"],
            "ci_long"))
def q_unpivot_trend(spark, sf_dir):
    """the weekly daily table as (Metric, Volume) rows."""
    return W.unpivot_trend(W.checkin_week_daily(_checkin_detail(spark, sf_dir)))


CI_KPI_COLS = ["week_start", "Current_Total", "Previous_Total", "Current_Days", "Previous_Days", "Rising_Hotels",
               "Hotels", "Action_Hotels", "Current_Basis", "Previous_Basis", "Change", "Change_Pct", "Complete",
               "Signal"]


@register("checkin_week_kpis", CI_SQL + f""",
ck_d AS (SELECT week_start, sum(Current_Searches) AS Current_Total, sum(Previous_Searches) AS Previous_Total
         FROM ci_dest GROUP BY ALL),
ck_n AS (
  SELECT week_start, count(DISTINCT CASE WHEN Period = 'Selected week' THEN checkin_date END) AS Current_Days,
         count(DISTINCT CASE WHEN Period = 'Previous week' THEN checkin_date END) AS Previous_Days
  FROM ci_daily GROUP BY ALL
),
ck_h AS (
  SELECT week_start, count_if(coalesce(View_Change > 0, FALSE)) AS Rising_Hotels, count(*) AS Hotels,
         count_if(Action) AS Action_Hotels
  FROM ci_hotels GROUP BY ALL
),
ck0 AS (
  SELECT d.*, n.Current_Days, n.Previous_Days, h.Rising_Hotels, h.Hotels, h.Action_Hotels,
         (n.Current_Days = 7 AND n.Previous_Days = 7) AS Complete
  FROM ck_d d JOIN ck_n n USING (week_start) LEFT JOIN ck_h h USING (week_start)
),
ck1 AS (
  SELECT *,
    CASE WHEN Complete THEN Current_Total WHEN Current_Days <> 0 THEN Current_Total / Current_Days END AS Current_Basis,
    CASE WHEN Complete THEN Previous_Total WHEN Previous_Days <> 0 THEN Previous_Total / Previous_Days END
      AS Previous_Basis
  FROM ck0
),
ck2 AS (
  SELECT *, Current_Basis - Previous_Basis AS Change,
         CASE WHEN Previous_Basis <> 0 THEN (Current_Basis - Previous_Basis) / Previous_Basis END AS Change_Pct
  FROM ck1
),
ck AS (
  SELECT *, CASE WHEN Change_Pct IS NULL THEN 'No baseline' ELSE {_signal_case('Change_Pct')} END AS Signal FROM ck2
)""" + _sel(CI_KPI_COLS, ["Current_Total", "Previous_Total", "Current_Basis", "Previous_Basis", "Change", "Change_Pct"],
            "ck"))
def q_checkin_week_kpis(spark, sf_dir):
    """check-in week KPIs (totals or per-day averages), change and signal."""
    return W.checkin_week_kpis(_checkin_detail(spark, sf_dir)).select(*CI_KPI_COLS)


# ---------------------------------------------------------------- merge (F5/F6) and audit

from staylens.operators import audit as AU  # noqa: E402
from staylens.operators import merge as M  # noqa: E402
from staylens.plans import batch_index as BI  # noqa: E402
from staylens.plans import daystore as DS  # noqa: E402
from staylens.session import checkpoint_dir  # noqa: E402
from staylens.sources.driver_tables import DEMAND_COLUMNS, PREVIOUS_CUTOFF  # noqa: E402


def _merge(spark, sf_dir) -> M.MergeResult:
    """History = the previous export as stored; upload = everything the latest load adds or re-sends."""
    history = T.demand_previous(spark, sf_dir)
    latest_all = T.demand_latest(spark, sf_dir)
    upload = latest_all.where(
        (F.col("snapshot_at") >= F.lit(PREVIOUS_CUTOFF).cast("timestamp_ntz")) | (F.col("load_seq") == 1)
    )
    return M.merge_incremental(history, upload)


MERGE_CTES = [O.DEMAND_ROWS, f"""
m_hist AS (
  SELECT {O.DEMAND_COLS}, 0 AS load_seq, row_seq FROM demand_rows WHERE snapshot_at < TIMESTAMP '{PREVIOUS_CUTOFF}'
),
m_upl AS (
  SELECT {O.DEMAND_COLS}, 0 AS load_seq, row_seq FROM demand_rows WHERE snapshot_at >= TIMESTAMP '{PREVIOUS_CUTOFF}'
  UNION ALL
  SELECT snapshot_at, checkin_date, ProductID, ProductName, Destination, trend_momentum, hotness_score,
         check_status, search_volume, view_volume + 1, 1, row_seq FROM demand_rows WHERE event_type = 'purchase'
),
m_inc AS (SELECT * FROM m_upl WHERE ProductID IS NOT NULL),
m_comb AS (SELECT *, 0 AS _src FROM m_hist UNION ALL SELECT *, 1 AS _src FROM m_inc),
m_win AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_at, checkin_date, ProductID
                                 ORDER BY _src DESC, load_seq DESC, row_seq DESC) AS _rn
    FROM m_comb WHERE snapshot_at IS NOT NULL AND checkin_date IS NOT NULL AND ProductID IS NOT NULL
  ) WHERE _rn = 1
),
m_merged AS (
  SELECT * EXCLUDE (_src) FROM m_win
  UNION ALL
  SELECT * FROM m_hist WHERE snapshot_at IS NULL OR checkin_date IS NULL OR ProductID IS NULL
),
m_h1 AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_at, checkin_date, ProductID
                                 ORDER BY load_seq DESC, row_seq DESC) AS _rn
    FROM m_hist WHERE snapshot_at IS NOT NULL AND checkin_date IS NOT NULL AND ProductID IS NOT NULL
  ) WHERE _rn = 1
),
m_cmp AS (
  SELECT u.*, h.ProductID IS NULL AS is_new,
         h.ProductID IS NULL
         OR u.ProductName IS DISTINCT FROM h.ProductName OR u.Destination IS DISTINCT FROM h.Destination
         OR u.trend_momentum IS DISTINCT FROM h.trend_momentum OR u.hotness_score IS DISTINCT FROM h.hotness_score
         OR u.check_status IS DISTINCT FROM h.check_status OR u.search_volume IS DISTINCT FROM h.search_volume
         OR u.view_volume IS DISTINCT FROM h.view_volume AS differs
  FROM (SELECT * FROM m_win WHERE _src = 1) u
  LEFT JOIN m_h1 h USING (snapshot_at, checkin_date, ProductID)
)"""]


@register("merge_incremental", O.with_ctes(*MERGE_CTES)
          + _sel(DEMAND_COLUMNS, ["trend_momentum", "hotness_score", "search_volume", "view_volume"], "m_merged"))
def q_merge_incremental(spark, sf_dir):
    """the history after merging the latest upload (keyed upsert, later load wins)."""
    return _merge(spark, sf_dir).merged.select(*DEMAND_COLUMNS)


MERGE_STATS = """ SELECT
  (SELECT count(*) FROM m_hist) AS history_rows,
  (SELECT count(*) FROM m_upl) AS uploaded_rows,
  (SELECT count(*) FROM m_upl WHERE ProductID IS NULL) AS skipped_missing_product,
  (SELECT count_if(is_new) FROM m_cmp) AS new_events,
  (SELECT count(*) FROM m_hist) + (SELECT count(*) FROM m_inc) - (SELECT count(*) FROM m_merged) AS duplicates_removed,
  (SELECT count(*) FROM m_merged) AS merged_rows,
  (SELECT count_if(differs) > 0 FROM m_cmp) AS data_changed,
  (SELECT min(snapshot_at) FROM m_inc) AS upload_min_timestamp,
  (SELECT max(snapshot_at) FROM m_inc) AS upload_max_timestamp"""


@register("merge_stats", O.with_ctes(*MERGE_CTES) + MERGE_STATS)
def q_merge_stats(spark, sf_dir):
    """F5 + F6: merge statistics, including whether the upload changed anything."""
    return _merge(spark, sf_dir).stats


STATS_TYPES = ("history_rows long, uploaded_rows long, skipped_missing_product long, new_events long, duplicates_removed long, "
               "merged_rows long, data_changed boolean, upload_min_timestamp timestamp_ntz, upload_max_timestamp timestamp_ntz")


def _day_store(spark, sf_dir) -> DS.DayStore:
    """A new store by day that holds the previous export."""
    store = DS.DayStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/staylens-stores/{uuid.uuid4().hex}")
    DS.create(spark, store.folder, T.demand_previous(spark, sf_dir))
    return store


def _upload(spark, sf_dir) -> DataFrame:
    later = F.col("snapshot_at") >= F.lit(PREVIOUS_CUTOFF).cast("timestamp_ntz")
    return T.demand_latest(spark, sf_dir).where(later | (F.col("load_seq") == 1))


def _stats_row(spark, stats: dict) -> DataFrame:
    names = [c.split()[0] for c in STATS_TYPES.split(", ")]
    return spark.createDataFrame([tuple(stats[n] for n in names)], STATS_TYPES)


STORED = [c for c in DEMAND_COLUMNS if c != "load_seq"]  # the store numbers loads itself


@register("merge_by_day", O.with_ctes(*MERGE_CTES) + _sel(STORED, ["trend_momentum", "hotness_score", "search_volume", "view_volume"], "m_merged"))
def q_merge_by_day(spark, sf_dir):
    """SNK4 / F5: the committed store after the latest upload was merged into the days it touches."""
    store = _day_store(spark, sf_dir)
    store.commit(store.stage(_upload(spark, sf_dir)).manifest)
    return store.read(store.manifest()).select(*STORED)


@register("merge_by_day_stats", O.with_ctes(*MERGE_CTES) + MERGE_STATS)
def q_merge_by_day_stats(spark, sf_dir):
    """SNK4 / F6: statistics of that merge, from the touched days and the manifest."""
    return _stats_row(spark, _day_store(spark, sf_dir).stage(_upload(spark, sf_dir)).stats)


NOOP_CTES = [c.replace("m_upl AS (", "m_upl AS (SELECT * FROM m_hist WHERE check_status = 'modify'),\nm_later AS (") for c in MERGE_CTES]


@register("merge_noop", O.with_ctes(*NOOP_CTES) + MERGE_STATS)
def q_merge_noop(spark, sf_dir):
    """an upload that re-sends stored rows changes nothing and publishes nothing."""
    store = _day_store(spark, sf_dir)
    staged = store.stage(store.read(store.manifest()).where("check_status = 'modify'"))
    if staged.manifest is not None:
        raise RuntimeError("an upload of stored rows was taken for a change")
    return _stats_row(spark, staged.stats)


@register("batch_map_by_day", O.with_ctes(*MERGE_CTES, O.batched("m_merged", "mb"))
          + " SELECT snapshot_at, Observation_Batch, Observation_At FROM mb_map")
def q_batch_map_by_day(spark, sf_dir):
    """A1 kept by day: the batch map after a merge, numbered again from the first day that changed."""
    store = _day_store(spark, sf_dir)
    index = BI.BatchIndex(store, 300)
    index.update()
    store.commit(store.stage(_upload(spark, sf_dir)).manifest)
    index.update()
    return index.batch_map()


@register("raw_key_quality", O.with_ctes(*RAW, O.PREVIOUS.replace(
    "AND ProductID IS NOT NULL AND ProductName IS NOT NULL", "").replace("previous AS", "previous_raw AS"))
    + """ SELECT 'latest' AS source, count_if(snapshot_at IS NULL) AS invalid_timestamp_rows,
  count_if(checkin_date IS NULL) AS invalid_checkin_rows, count_if(ProductID IS NULL) AS missing_product_rows,
  count(*) - count(DISTINCT (snapshot_at, checkin_date, ProductID)) AS duplicate_event_keys FROM latest_raw
  UNION ALL SELECT 'previous', count_if(snapshot_at IS NULL), count_if(checkin_date IS NULL),
  count_if(ProductID IS NULL), count(*) - count(DISTINCT (snapshot_at, checkin_date, ProductID)) FROM previous_raw""")
def q_raw_key_quality(spark, sf_dir):
    """Key quality of the latest and previous raw exports."""
    a = AU.raw_key_quality(T.demand_latest(spark, sf_dir)).select(F.lit("latest").alias("source"), "*")
    b = AU.raw_key_quality(T.demand_previous(spark, sf_dir)).select(F.lit("previous").alias("source"), "*")
    return a.unionByName(b)


@register("master_conflicts", O.with_ctes(O.ENGINE.split("roll AS (")[0].rstrip().rstrip(",")) + """,
mc_m AS (SELECT ProductID, count(*) AS n, count(DISTINCT coalesce(ProductName, '<NA>')) AS d1,
         count(DISTINCT coalesce(Destination, '<NA>')) AS d2, count(DISTINCT coalesce(Region, '<NA>')) AS d3,
         count(DISTINCT coalesce("HotelType Short", '<NA>')) AS d4
         FROM master WHERE ProductID IS NOT NULL GROUP BY ALL),
mc_p AS (SELECT ProductID, count(*) AS n, count(DISTINCT coalesce(ProductName, '<NA>')) AS d1,
         count(DISTINCT coalesce("Agoda Status", '<NA>')) AS d2, count(DISTINCT coalesce("Ctrip Status", '<NA>')) AS d3,
         1 AS d4
         FROM (SELECT ProductID, 'Hotel ' || CAST(ProductID AS VARCHAR) AS ProductName, "Agoda Status", "Ctrip Status"
               FROM perf) WHERE ProductID IS NOT NULL GROUP BY ALL)
SELECT 'master' AS source, count(*) AS duplicate_ids,
       coalesce(count_if(d1 > 1 OR d2 > 1 OR d3 > 1 OR d4 > 1), 0) AS conflicting_ids
  FROM mc_m WHERE n > 1
UNION ALL
SELECT 'performance', count(*), coalesce(count_if(d1 > 1 OR d2 > 1 OR d3 > 1 OR d4 > 1), 0) FROM mc_p WHERE n > 1""")
def q_master_conflicts(spark, sf_dir):
    """Duplicated and conflicting hotel ids in the master and performance sheets."""
    a = AU.master_conflicts(T.hotel_master(spark, sf_dir)).select(F.lit("master").alias("source"), "*")
    b = AU.master_conflicts(T.hotel_performance(spark, sf_dir)).select(F.lit("performance").alias("source"), "*")
    return a.unionByName(b)


WIN_SQL = O.with_ctes(O.DEMAND_ROWS, O.LATEST, O.PREVIOUS, *O.periods_sql(300))


@register("search_conflicts", WIN_SQL + """ SELECT count_if(v > 1) AS inconsistent_search_groups FROM (
  SELECT Observation_Batch, Destination, checkin_date, count(DISTINCT search_volume) AS v FROM cb
  WHERE Destination IS NOT NULL AND checkin_date IS NOT NULL GROUP BY ALL)""")
def q_search_conflicts(spark, sf_dir):
    """Destination search groups with conflicting raw values in the current window."""
    return AU.search_conflicts(_rebuild(spark, sf_dir).windows.current)


@register("batch_sizes", WIN_SQL + """ SELECT min(n) AS min_rows, round(median(n), 9) + 0.0 AS median_rows,
  max(n) AS max_rows, count(*) AS batches FROM (SELECT Observation_Batch, count(*) AS n FROM cb GROUP BY ALL)""")
def q_batch_sizes(spark, sf_dir):
    """Rows per observation batch in the current window."""
    return AU.batch_sizes(_rebuild(spark, sf_dir).windows.current)


def _reconcile_sql(name: str, exp: str, act: str, keys: str, pairs: list[tuple[str, str]]) -> str:
    differs = " OR ".join(
        f"coalesce(abs({e} - {a}) > 1e-6, FALSE) OR (({e}) IS NULL) <> (({a}) IS NULL)" for e, a in pairs
    )
    return f"""SELECT '{name}' AS "check", count(*) AS compared_keys,
  coalesce(count_if(_a IS NULL), 0) AS missing_in_actual, coalesce(count_if(_e IS NULL), 0) AS missing_in_expected,
  coalesce(count_if(_a IS NOT NULL AND _e IS NOT NULL AND ({differs})), 0) AS value_different
  FROM (SELECT *, TRUE AS _e FROM {exp}) FULL OUTER JOIN (SELECT *, TRUE AS _a FROM {act}) USING ({keys})"""


AUDIT_SQL = O.with_ctes(*O.full_chain(300)) + """,
au_n AS (SELECT (SELECT count(DISTINCT Observation_Batch) FROM cb) AS n,
                (SELECT count(DISTINCT Observation_Batch) FROM bb) AS m),
au_ed AS (
  SELECT d.Destination, d.checkin_date, d.Destination_Searches AS e1,
         d.Destination_Searches / d.Destination_Intervals
           * CASE WHEN p.Destination_Intervals IS NOT NULL THEN least(d.Destination_Intervals, p.Destination_Intervals) END AS e2,
         p.Destination_Searches / p.Destination_Intervals
           * CASE WHEN p.Destination_Intervals IS NOT NULL THEN least(d.Destination_Intervals, p.Destination_Intervals) END AS e3
  FROM cd d LEFT JOIN pd p USING (Destination, checkin_date)
),
au_ad AS (
  SELECT Destination, checkin_date, max(Destination_Searches) AS a1, max(Comparable_Destination_Searches) AS a2,
         max(Previous_Comparable_Destination_Searches) AS a3
  FROM funnel WHERE Destination IS NOT NULL GROUP BY ALL
),
au_eh AS (
  SELECT h.ProductID, h.checkin_date, h.view_volume AS e1,
         h.view_volume / h.Interval_Count
           * CASE WHEN p.Interval_Count IS NOT NULL THEN least(h.Interval_Count, p.Interval_Count) END AS e2,
         p.view_volume / p.Interval_Count
           * CASE WHEN p.Interval_Count IS NOT NULL THEN least(h.Interval_Count, p.Interval_Count) END AS e3
  FROM ch h LEFT JOIN ph p USING (ProductID, checkin_date)
),
au_ah AS (SELECT ProductID, checkin_date, view_volume AS a1, Comparable_Views AS a2, Previous_Comparable_Views AS a3
          FROM funnel),
au_rows AS (
  SELECT 'window_batches' AS "check", n AS compared_keys, CAST(0 AS BIGINT) AS missing_in_actual,
         CAST(0 AS BIGINT) AS missing_in_expected, CAST(abs(n - m) AS BIGINT) AS value_different FROM au_n
  UNION ALL """ + _reconcile_sql("destination_searches", "au_ed", "au_ad", "Destination, checkin_date",
                                 [("e1", "a1"), ("e2", "a2"), ("e3", "a3")]) + """
  UNION ALL """ + _reconcile_sql("hotel_views", "au_eh", "au_ah", "ProductID, checkin_date",
                                 [("e1", "a1"), ("e2", "a2"), ("e3", "a3")]) + """
  UNION ALL """ + _reconcile_sql("history_destinations", "(SELECT Destination, checkin_date, Total_Observed_Searches AS e1 FROM hist_d)",
                                 "(SELECT Destination, checkin_date, Total_Observed_Searches AS a1 FROM hist_d)",
                                 "Destination, checkin_date", [("e1", "a1")]) + """
  UNION ALL """ + _reconcile_sql("history_hotels", "(SELECT ProductID, checkin_date, Total_Observed_Views AS e1 FROM hist_h)",
                                 "(SELECT ProductID, checkin_date, Total_Observed_Views AS a1 FROM hist_h)",
                                 "ProductID, checkin_date", [("e1", "a1")]) + """
)"""


@register("audit", AUDIT_SQL + """ SELECT *, missing_in_actual + missing_in_expected + value_different = 0 AS passed
  FROM au_rows""")
def q_audit(spark, sf_dir):
    """Reconcile the published funnel and history with a recomputation."""
    r = _rebuild(spark, sf_dir)
    expected = facts.stored_history(r.latest, r.previous, r.gap)
    published = tuple(cut_lineage(t, "published_history") for t in r.history)
    return AU.audit(r.windows.current, r.windows.baseline, r.funnel, expected, published)


# ---------------------------------------------------------------- cleaning and dimension steps

DEMAND_DOUBLES = ["trend_momentum", "hotness_score", "search_volume", "view_volume"]


@register("prepare_demand", O.with_ctes(*RAW) + _sel(DEMAND_COLUMNS, DEMAND_DOUBLES, "latest"))
def q_prepare_demand(spark, sf_dir):
    """PRJ2: typed latest demand without rows lacking ProductID or name."""
    return latest(spark, sf_dir).select(*DEMAND_COLUMNS)


@register("split_invalid", O.with_ctes(*RAW) + _sel(DEMAND_COLUMNS, DEMAND_DOUBLES,
          "(SELECT * FROM latest_raw WHERE snapshot_at IS NULL OR checkin_date IS NULL OR ProductID IS NULL)"))
def q_split_invalid(spark, sf_dir):
    """PRJ6: the quarantine of latest rows without a full event key."""
    return clean.split_invalid(T.demand_latest(spark, sf_dir))[1].select(*DEMAND_COLUMNS)


@register("invalid_statuses", """
SELECT DISTINCT lower(event_type) AS check_status FROM events
WHERE event_id % 4 NOT IN (0, 1) AND trim(event_type) <> ''""")
def q_invalid_statuses(spark, sf_dir):
    """PRJ5: all unsupported statuses of an upload whose statuses are padded, blank, valid or event types in capitals."""
    kind = F.col("event_id") % 4
    status = F.when(kind == 0, " Continues ").when(kind == 1, " ").otherwise(F.concat(F.lit(" "), F.upper("event_type")))
    return clean.invalid_statuses(T.table(spark, sf_dir, "events").select(status.alias("check_status")))


@register("dedupe_performance", O.with_ctes(O.ENGINE.split("roll AS (")[0].rstrip().rstrip(","))
          + _sel(["ProductID", "Agoda Status", "Ctrip Status", "Revenue", "B2B2C RN"], ["Revenue", "B2B2C RN"], "p1"))
def q_dedupe_performance(spark, sf_dir):
    """One performance row per hotel (highest revenue, then room nights)."""
    return E.dedupe_performance(T.hotel_performance(spark, sf_dir)).select(
        "ProductID", "`Agoda Status`", "`Ctrip Status`", "Revenue", "`B2B2C RN`")


ROLL_COLS = ["ProductID", "Destination_Search_Context", "Funnel_Views", "Funnel_Bookings", "Internal_Worst_Gap",
             "Internal_Median_Gap", "Internal_Comparable_Rates", "Internal_Total_Rates", "Agoda_Price_Disadvantage",
             "Agoda_Comparable_Dates", "Views_per_Search", "Search_to_Booking"]


@register("funnel_rollup", O.with_ctes(*O.funnel_sql(300), O.ENGINE.split("e0 AS (")[0].rstrip().rstrip(","))
          + _sel(ROLL_COLS, ["Destination_Search_Context", "Funnel_Views", "Funnel_Bookings", "Internal_Worst_Gap",
                             "Internal_Median_Gap", "Agoda_Price_Disadvantage", "Views_per_Search",
                             "Search_to_Booking"], "roll2"))
def q_funnel_rollup(spark, sf_dir):
    """Per-hotel roll-up of the current funnel."""
    return E.funnel_rollup(_rebuild(spark, sf_dir).funnel).select(*ROLL_COLS)


# ---------------------------------------------------------------- week options, freshness, aliases, corrupted audit

@register("checkin_week_options", FULL + """ SELECT week_start,
  CAST(isoyear(week_start) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(week_start) AS VARCHAR), 2, '0')
  || ' (' || strftime(week_start, '%d %b') || '–' || strftime(week_start + 6, '%d %b') || ')' AS label
  FROM (SELECT DISTINCT CAST(date_trunc('week', checkin_date) AS DATE) AS week_start FROM detail)""")
def q_checkin_week_options(spark, sf_dir):
    """ISO check-in weeks with labels."""
    return W.checkin_week_options(_detail(_rebuild(spark, sf_dir)))


@register("freshness", FULL + """ SELECT (SELECT max(snapshot_at) FROM latest_raw) AS Latest_Snapshot,
  (SELECT count(*) FROM daily WHERE "Demand Level" IN ('High', 'Very High')) AS High_Dates""")
def q_freshness(spark, sf_dir):
    """F16: the newest snapshot overall and the number of High + Very High dates."""
    return W.freshness(_raw_latest(spark, sf_dir), V.daily_market(_detail(_rebuild(spark, sf_dir))))


PROVINCE_CTES = """,
prov AS (
  SELECT n_name AS province FROM nation WHERE n_nationkey % 3 <> 0
  UNION ALL SELECT n_name || ' Province' FROM nation WHERE n_nationkey % 3 <> 1
  UNION ALL SELECT 'Old ' || n_name FROM nation WHERE n_nationkey % 5 = 1
),
prov_alias AS (SELECT n_name || ' Province' AS alias, n_name AS target FROM nation WHERE n_nationkey % 3 <> 1),
prov_dest AS (SELECT province, coalesce(target, province) AS Destination FROM prov LEFT JOIN prov_alias ON province = alias)"""


def _provinces(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Map names spelled as the destination, with a suffix that an alias covers, and with a prefix that none does."""
    nation, key, name = T.table(spark, sf_dir, "nation"), F.col("n_nationkey"), F.col("n_name")
    suffixed = F.concat(name, F.lit(" Province"))
    provinces = (
        nation.where(key % 3 != 0).select(name.alias("province"))
        .unionByName(nation.where(key % 3 != 1).select(suffixed.alias("province")))
        .unionByName(nation.where(key % 5 == 1).select(F.concat(F.lit("Old "), name).alias("province")))
    )
    return provinces, nation.where(key % 3 != 1).select(suffixed.alias("alias"), name.alias("Destination"))


def _mapped(spark, sf_dir) -> DataFrame:
    return V.map_table(*_rebuild(spark, sf_dir).history, T.destination_coordinates(spark, sf_dir))


PROVINCE_COLS = ["province", *MAP_COLS]


@register("province_demand", MAP_SQL + PROVINCE_CTES + _sel(PROVINCE_COLS, ["Searches", "Views", "Latitude", "Longitude"],
                                                            "(SELECT * FROM mp JOIN prov_dest USING (Destination))"))
def q_province_demand(spark, sf_dir):
    """The map table by province, through the alias map."""
    return V.province_demand(_mapped(spark, sf_dir), *_provinces(spark, sf_dir)).select(*PROVINCE_COLS)


@register("unmatched_provinces", MAP_SQL + PROVINCE_CTES + """ SELECT province, Destination FROM prov_dest
  WHERE Destination NOT IN (SELECT Destination FROM mp)""")
def q_unmatched_provinces(spark, sf_dir):
    """Map names that stand for no destination with demand."""
    return V.unmatched_provinces(_mapped(spark, sf_dir), *_provinces(spark, sf_dir)).select("province", "Destination")


def _corrupted(df: DataFrame, values: list[str]) -> DataFrame:
    """Rows lost, rows invented and values changed on fixed residues of the hotel or initials of the destination."""
    key, name = (F.col(c) if c in df.columns else None for c in ("ProductID", "Destination"))

    def hit(residue: int, initial: str):
        parts = ([key % residue == 0] if key is not None else []) + ([name.startswith(initial)] if name is not None else [])
        out = parts[0]
        for p in parts[1:]:
            out = out | p
        return F.coalesce(out, F.lit(False))

    kept = df.where(~hit(7, "I")).withColumns({v: F.when(hit(5, "A"), F.col(v) + 1).otherwise(F.col(v)) for v in values})
    return kept.unionByName(df.where(hit(11, "C")).withColumn("checkin_date", F.date_add("checkin_date", 1000)))


def _corrupted_sql(src: str, name: str, values: list[str], hotel: bool, destination: bool) -> str:
    def hit(residue: int, initial: str) -> str:
        parts = ([f"ProductID % {residue} = 0"] if hotel else []) + ([f"starts_with(Destination, '{initial}')"] if destination else [])
        return f"coalesce({' OR '.join(parts)}, FALSE)"

    changed = ", ".join(f"CASE WHEN {hit(5, 'A')} THEN {v} + 1 ELSE {v} END AS {v}" for v in values)
    return (f"{name} AS (SELECT * REPLACE ({changed}) FROM {src} WHERE NOT {hit(7, 'I')} "
            f"UNION ALL SELECT * REPLACE (checkin_date + 1000 AS checkin_date) FROM {src} WHERE {hit(11, 'C')})")


FUNNEL_VALUES = ["Destination_Searches", "Comparable_Destination_Searches", "Previous_Comparable_Destination_Searches",
                 "view_volume", "Comparable_Views", "Previous_Comparable_Views"]
CORRUPTED_SQL = (
    AUDIT_SQL.replace("\nau_n AS (", "\n" + ",\n".join([
        _corrupted_sql("funnel", "funnel_x", FUNNEL_VALUES, True, True),
        _corrupted_sql("hist_h", "hist_hx", ["Total_Observed_Views"], True, True),
        _corrupted_sql("hist_d", "hist_dx", ["Total_Observed_Searches"], False, True),
    ]) + ",\nau_n AS (", 1)
    .replace("FROM funnel WHERE Destination IS NOT NULL", "FROM funnel_x WHERE Destination IS NOT NULL")
    .replace("Previous_Comparable_Views AS a3\n          FROM funnel)", "Previous_Comparable_Views AS a3\n          FROM funnel_x)")
    .replace("Total_Observed_Searches AS a1 FROM hist_d)", "Total_Observed_Searches AS a1 FROM hist_dx)")
    .replace("Total_Observed_Views AS a1 FROM hist_h)", "Total_Observed_Views AS a1 FROM hist_hx)")
)


@register("audit_corrupted", CORRUPTED_SQL + """ SELECT *, missing_in_actual + missing_in_expected + value_different = 0 AS passed
  FROM au_rows""")
def q_audit_corrupted(spark, sf_dir):
    """A20 against published tables with lost rows, invented rows and changed values."""
    r = _rebuild(spark, sf_dir)
    hotels, destinations = r.history
    published = (_corrupted(hotels, ["Total_Observed_Views"]), _corrupted(destinations, ["Total_Observed_Searches"]))
    return AU.audit(r.windows.current, r.windows.baseline, _corrupted(r.funnel, FUNNEL_VALUES), r.history, published)


# ---------------------------------------------------------------- files: landing, sheets, publishing, snapshots

from staylens.plans import publish  # noqa: E402
from staylens.sources import files  # noqa: E402


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/staylens-files/{name}-{uuid.uuid4().hex}"


EXPORT_NAMES = dict(zip(["snapshot_at", "checkin_date"], ["Time Stamp", "CheckInDate"], strict=True))
LANDED = [c for c in DEMAND_COLUMNS if c not in ("load_seq", "row_seq")]


@register("scan_demand", O.with_ctes(*RAW, O.PREVIOUS.replace(
    "AND ProductID IS NOT NULL AND ProductName IS NOT NULL", "").replace("previous AS", "previous_raw AS"))
    + _sel(["source", *LANDED], DEMAND_DOUBLES, "(SELECT 'latest' AS source, * FROM latest_raw UNION ALL "
                                                "SELECT 'previous', * FROM previous_raw)"))
def q_scan_demand(spark, sf_dir):
    """SRC1-SRC4 + PRJ1/PRJ2 typing: both exports written as text under their file names, found, landed and typed again."""
    raw = _folder(spark, "raw")
    for name, rows in (("demand_latest.csv", T.demand_latest(spark, sf_dir)), ("demand_previous.csv", T.demand_previous(spark, sf_dir))):
        text = rows.select(*[F.col(c).cast("string").alias(EXPORT_NAMES.get(c, c)) for c in reversed(LANDED)])
        text.write.option("header", True).csv(f"{raw}/{name}")
    found = files.scan_demand(spark, raw).select(F.lit("latest").alias("source"), *LANDED)
    return found.unionByName(files.scan_previous(spark, raw).select(F.lit("previous").alias("source"), *LANDED))


@register("scan_master_sheet", """SELECT CAST(c_custkey AS VARCHAR) AS ProductID, c_name AS ProductName, n_name AS Destination,
  c_mktsegment AS "HotelType Short", r_name AS Region
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def q_scan_master_sheet(spark, sf_dir):
    """SRC8: the hotel master written as a CSV sheet and landed again, all text."""
    path = f"{_folder(spark, 'sheets')}/master.csv"
    T.hotel_master(spark, sf_dir).drop("row_seq").write.option("header", True).csv(path)
    return files.scan_table(spark, path).drop("load_seq", "row_seq")


@register("scan_ota_parity_sheet", SQL["scan_ota_parity"])
def q_scan_ota_parity_sheet(spark, sf_dir):
    """SRC7 from its file: a title line, the header on the second line, then the rows of the wide sheet."""
    wide = T.ota_parity_wide(spark, sf_dir)
    lines = wide.select(F.lit(2).alias("at"), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in wide.columns])).alias("value"))
    title = spark.createDataFrame([(0, '"OTA parity, by stay date"' + "," * 6), (1, ",".join(wide.columns))], "at int, value string")
    path = f"{_folder(spark, 'sheets')}/ota"
    # a sheet is one file
    title.unionByName(lines).repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    return feeds.ota_parity(files.land_sheet(spark, path, header_line=1))


@register("published_extracts", ENG + """ SELECT 'top20' AS extract, ProductID FROM engine WHERE "Commercial Rank" <= 20
  UNION ALL SELECT 'agoda_mapping', ProductID FROM engine WHERE Action = 'Map Hotel to Agoda'
  UNION ALL SELECT 'ctrip_mapping', ProductID FROM engine WHERE Action = 'Expand to Ctrip'
  UNION ALL SELECT 'room_type_mapping', ProductID FROM engine WHERE Action = 'Complete Room-Type Mapping'""")
def q_published_extracts(spark, sf_dir):
    """SNK1 + SNK2 + SRC10: the engine published as a version, its extracts read from the marked one."""
    out = _folder(spark, "out")
    publish.publish_outputs(spark, {"engine": _rebuild(spark, sf_dir).engine}, out)
    parts = [files.read_published(spark, out, n).select(F.lit(n).alias("extract"), "ProductID") for n in ("top20", *publish.EXTRACT_ACTIONS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("newest_snapshots", ENG + """ SELECT 3 - day AS age, DATE '2024-02-01' + CAST(day AS INT) AS snapshot_date, ProductID,
  CAST("Commercial Rank" + day AS BIGINT) AS rank FROM engine, range(1, 3) d(day)""")
def q_newest_snapshots(spark, sf_dir):
    """SNK3 + SRC11: three dated engine snapshots, one of them rewritten; the newest two read with pruned folders."""
    import datetime as dt

    out = _folder(spark, "snapshots")
    engine = cut_lineage(_rebuild(spark, sf_dir).engine.select("ProductID", F.col("`Commercial Rank`").alias("rank")), "engine")
    for day, shift in ((0, 0), (2, 9), (1, 1), (2, 2)):
        publish.save_snapshot(engine.withColumn("rank", F.col("rank") + shift), out, dt.date(2024, 2, 1) + dt.timedelta(days=day))
    return files.newest_snapshots(spark, out).select(F.col("age").cast("bigint").alias("age"), "snapshot_date", "ProductID", "rank")


# ---------------------------------------------------------------- the daily page over a snapshot week

SW_PAGE = SW_SQL + f""",
swd AS (
  SELECT week_start, checkin_date, Destination, max(Destination_Searches) AS s, max(Previous_Destination_Searches) AS p,
         max(Previous_Comparable_Destination_Searches) AS pc, max(Destination_Search_Change) AS ch FROM sw GROUP BY ALL
),
swm AS (
  SELECT * FROM (SELECT week_start, checkin_date, coalesce(sum(s), 0.0) AS Searches FROM swd GROUP BY ALL)
  FULL OUTER JOIN (SELECT week_start, checkin_date, coalesce(sum(view_volume), 0.0) AS Views, count(DISTINCT ProductID) AS Hotels
                   FROM sw GROUP BY ALL) USING (week_start, checkin_date)
),
swq AS (SELECT week_start, quantile_cont(Searches, [0.4, 0.75, 0.9]) AS q FROM swm GROUP BY ALL),
sw_market AS (
  SELECT m.*, CASE WHEN Searches >= q[3] THEN 'Very High' WHEN Searches >= q[2] THEN 'High' WHEN Searches >= q[1] THEN 'Medium'
                   ELSE 'Low' END AS "Demand Level" FROM swm m JOIN swq USING (week_start)
),
sw_signal AS (
  SELECT week_start, checkin_date, Destination, CASE WHEN p IS NULL THEN 'New demand'
         ELSE {_signal_case("(CASE WHEN pc > 0 THEN ch / pc END)")} END AS "Destination Signal" FROM swd
),
sw_day AS (SELECT week_start, checkin_date, quantile_cont(coalesce(view_volume, 0.0), 0.75) AS q75 FROM sw GROUP BY ALL),
sw_hotel AS (
  SELECT w.week_start, w.checkin_date, w.ProductID,
         CASE WHEN Previous_Views IS NULL OR coalesce(check_status = 'new entry', FALSE) THEN 'New interest'
              ELSE {_signal_case("(CASE WHEN Previous_Comparable_Views > 0 THEN View_Change / Previous_Comparable_Views END)")} END AS "Hotel Signal",
         coalesce(g."Destination Signal" IN ('Critical surge', 'High increase', 'New demand')
                  AND (coalesce(View_Change > 0, FALSE) OR coalesce(coalesce(view_volume, 0.0) >= q75, FALSE)), FALSE) AS Action
  FROM sw w LEFT JOIN sw_signal g ON w.week_start = g.week_start AND w.checkin_date = g.checkin_date AND w.Destination IS NOT DISTINCT FROM g.Destination
       JOIN sw_day h ON w.week_start = h.week_start AND w.checkin_date = h.checkin_date
)"""


def _week_detail(spark, sf_dir) -> DataFrame:
    weekly = W.snapshot_week(_raw_latest(spark, sf_dir), 300)
    return cut_lineage(V.home_detail(weekly, _rebuild(spark, sf_dir).engine), "week_detail")


@register("snapshot_week_market", SW_PAGE + _sel(["week_start", "checkin_date", "Searches", "Views", "Hotels", "Demand Level"],
                                                 ["Searches", "Views"], "sw_market"))
def q_snapshot_week_market(spark, sf_dir):
    """A8 + W3 over F7: the market table of every snapshot week."""
    return V.daily_market(_week_detail(spark, sf_dir), ["week_start"])


@register("snapshot_week_signals", SW_PAGE + """ SELECT week_start, checkin_date, ProductID, "Hotel Signal", Action FROM sw_hotel""")
def q_snapshot_week_signals(spark, sf_dir):
    """W6 + W8 + W11 over F7: hotel signals and actions of every snapshot week."""
    rows = V.hotel_signal_daily(_week_detail(spark, sf_dir), ["week_start"])
    return rows.select("week_start", "checkin_date", "ProductID", "`Hotel Signal`", "Action")
