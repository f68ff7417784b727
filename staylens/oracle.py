"""ANSI SQL (DuckDB dialect) twins of the registered queries.

Each query is a chain of common table expressions over the driver's
tables.  The SQL is written independently of the Spark code: batching is
the plain single-window form, keep-last is ``row_number``, medians are
``median``.  Double results are rounded to 9 places on both sides to
absorb summation-order noise.
"""

from __future__ import annotations

from staylens.sources.driver_tables import (
    AGODA_BY_MOD5,
    CTRIP_BY_MOD4,
    OTA_DATES,
    PREVIOUS_CUTOFF,
    RENAME_FROM,
)


def _case_mod(expr: str, values) -> str:
    parts = []
    for i, v in enumerate(values):
        lit = "NULL" if v is None else "'" + v.replace("'", "''") + "'"
        parts.append(f"WHEN ({expr}) % {len(values)} = {i} THEN {lit}")
    return "CASE " + " ".join(parts) + " END"


DEMAND_ROWS = f"""
demand_rows AS (
  SELECT e.ts AS snapshot_at,
         CAST(e.ts AS DATE) + CAST(e.event_id % 14 AS INTEGER) AS checkin_date,
         CASE WHEN e.event_id % 101 <> 0 THEN e.user_id END AS ProductID,
         'Hotel ' || CAST(e.user_id AS VARCHAR)
           || CASE WHEN e.ts >= TIMESTAMP '{RENAME_FROM}' THEN ' Resort' ELSE '' END AS ProductName,
         CASE WHEN e.event_id % 97 <> 0 THEN n.n_name END AS Destination,
         CAST((e.event_id % 21 - 5) / 20.0 AS DOUBLE) AS trend_momentum,
         CASE WHEN e.event_id % 13 <> 0
              THEN CAST(regexp_extract(e.props, '([0-9]+)', 1) AS DOUBLE) / 100.0 END AS hotness_score,
         CASE e.event_type WHEN 'signup' THEN 'new entry' WHEN 'purchase' THEN 'modify'
              ELSE 'continues' END AS check_status,
         CAST(e.value AS DOUBLE) AS search_volume,
         CAST(regexp_extract(e.props, '([0-9]+)', 1) AS DOUBLE) AS view_volume,
         e.event_type,
         e.event_id AS row_seq
  FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id % 25
)"""

DEMAND_COLS = (
    "snapshot_at, checkin_date, ProductID, ProductName, Destination, trend_momentum, "
    "hotness_score, check_status, search_volume, view_volume"
)

LATEST = f"""
latest_raw AS (
  SELECT {DEMAND_COLS}, 0 AS load_seq, row_seq FROM demand_rows
  UNION ALL
  SELECT snapshot_at, checkin_date, ProductID, ProductName, Destination, trend_momentum,
         hotness_score, check_status, search_volume, view_volume + 1, 1 AS load_seq, row_seq
  FROM demand_rows WHERE event_type = 'purchase'
),
latest AS (
  SELECT * FROM latest_raw WHERE ProductID IS NOT NULL AND ProductName IS NOT NULL
)"""

PREVIOUS = f"""
previous AS (
  SELECT {DEMAND_COLS}, 0 AS load_seq, row_seq FROM demand_rows
  WHERE snapshot_at < TIMESTAMP '{PREVIOUS_CUTOFF}'
    AND ProductID IS NOT NULL AND ProductName IS NOT NULL
)"""


def batched(src: str, name: str, gap: int = 300, scope: str = "") -> str:
    """``name``: rows of ``src`` with a time stamp plus Observation_Batch / _At."""
    part = f"PARTITION BY {scope}" if scope else ""
    scope_cols = f"{scope}, " if scope else ""
    join_scope = "".join(f" AND s.{c.strip()} = m.{c.strip()}" for c in scope.split(",")) if scope else ""
    return f"""
{name}_stamps AS (
  SELECT DISTINCT {scope_cols}snapshot_at FROM {src} WHERE snapshot_at IS NOT NULL
),
{name}_flags AS (
  SELECT {scope_cols}snapshot_at,
         CASE WHEN lag(snapshot_at) OVER ({part} ORDER BY snapshot_at) IS NULL
                OR snapshot_at - lag(snapshot_at) OVER ({part} ORDER BY snapshot_at) > INTERVAL {int(gap)} SECOND
              THEN 1 ELSE 0 END AS f
  FROM {name}_stamps
),
{name}_ids AS (
  SELECT {scope_cols}snapshot_at,
         CAST(sum(f) OVER ({part} ORDER BY snapshot_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
           AS Observation_Batch
  FROM {name}_flags
),
{name}_map AS (
  SELECT {scope_cols}snapshot_at, Observation_Batch,
         max(snapshot_at) OVER (PARTITION BY {scope_cols}Observation_Batch) AS Observation_At
  FROM {name}_ids
),
{name} AS (
  SELECT s.*, m.Observation_Batch, m.Observation_At
  FROM {src} s JOIN {name}_map m ON s.snapshot_at = m.snapshot_at{join_scope}
)"""


def keep_last(src: str, name: str, keys: str, order: str = "snapshot_at DESC, load_seq DESC, row_seq DESC",
              where: str = "TRUE") -> str:
    return f"""
{name} AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS _rn
    FROM {src} WHERE {where}
  ) WHERE _rn = 1
)"""


def hotel_checkin(src_batched: str, name: str, scope: str = "") -> str:
    """A2 over a batched relation."""
    sc = f"{scope}, " if scope else ""
    return keep_last(
        src_batched, f"{name}_iv", f"{sc}Observation_Batch, ProductID, checkin_date",
        where="ProductID IS NOT NULL AND checkin_date IS NOT NULL",
    ) + f""",
{name} AS (
  SELECT {sc}ProductID, checkin_date,
         max(snapshot_at) AS snapshot_at,
         avg(hotness_score) AS hotness_score,
         avg(trend_momentum) AS trend_momentum,
         median(search_volume) AS search_volume,
         coalesce(sum(view_volume), 0.0) AS view_volume,
         count(*) AS Interval_Count,
         arg_max_null(ProductName, snapshot_at) AS ProductName,
         arg_max_null(Destination, snapshot_at) AS Destination,
         arg_max_null(check_status, snapshot_at) AS check_status
  FROM {name}_iv GROUP BY ALL
)"""


def destination_checkin(src_batched: str, name: str, scope: str = "") -> str:
    """A3 over a batched relation."""
    sc = f"{scope}, " if scope else ""
    return f"""
{name}_pb AS (
  SELECT {sc}Observation_Batch, Observation_At, Destination, checkin_date,
         median(search_volume) AS search_volume
  FROM {src_batched}
  WHERE Destination IS NOT NULL AND checkin_date IS NOT NULL
  GROUP BY ALL
),
{name} AS (
  SELECT {sc}Destination, checkin_date,
         max(Observation_At) AS Destination_Search_Snapshot,
         coalesce(sum(search_volume), 0.0) AS Destination_Searches,
         count(*) AS Destination_Intervals
  FROM {name}_pb GROUP BY ALL
)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts)


AGODA_CASE = _case_mod("o_custkey", AGODA_BY_MOD5)
CTRIP_CASE = _case_mod("o_custkey", CTRIP_BY_MOD4)
OTA_DATE_LIST = OTA_DATES


def q(name: str) -> str:
    return '"' + name + '"'


def select_rounded(cols: list[str], doubles: set[str], src: str) -> str:
    parts = []
    for c in cols:
        ident = q(c)
        parts.append(f"round(CAST({ident} AS DOUBLE), 9) + 0.0 AS {ident}" if c in doubles else ident)
    return f" SELECT {', '.join(parts)} FROM {src}"


# current window re-batched on its own rows; baseline = newest n batches.
PERIODS = """
bl_stamps_only AS (SELECT DISTINCT snapshot_at FROM latest WHERE snapshot_at IS NOT NULL),
bp_stamps_only AS (SELECT DISTINCT snapshot_at FROM previous WHERE snapshot_at IS NOT NULL),
bounds0 AS (
  SELECT (SELECT count(*) FROM bp_stamps_only) > 0 AS has_prev,
         (SELECT min(snapshot_at) FROM bl_stamps_only
           WHERE snapshot_at NOT IN (SELECT snapshot_at FROM bp_stamps_only)) AS first_new,
         CAST(CAST((SELECT max(snapshot_at) FROM latest) AS DATE) AS TIMESTAMP) AS day_start
),
bounds AS (
  SELECT has_prev AND first_new IS NOT NULL AS has_new,
         CASE WHEN has_prev AND first_new IS NOT NULL THEN first_new ELSE day_start END AS cur_start,
         day_start
  FROM bounds0
),
cur_rows AS (SELECT l.* FROM latest l, bounds b WHERE l.snapshot_at >= b.cur_start)
"""

PERIODS_TAIL = """
cur_n AS (SELECT count(DISTINCT Observation_Batch) AS n FROM cb),
base_src AS (
  SELECT p.* FROM bp p, bounds b WHERE b.has_new
  UNION ALL
  SELECT l.* FROM bl l, bounds b WHERE NOT b.has_new AND l.snapshot_at < b.day_start
),
base_pick AS (
  SELECT Observation_Batch FROM (
    SELECT Observation_Batch, row_number() OVER (ORDER BY Observation_At DESC) AS rk
    FROM (SELECT DISTINCT Observation_Batch, Observation_At FROM base_src)
  ) WHERE rk <= (SELECT n FROM cur_n)
),
base_rows AS (
  SELECT * EXCLUDE (Observation_Batch, Observation_At) FROM base_src
  WHERE Observation_Batch IN (SELECT Observation_Batch FROM base_pick)
),
has_base AS (SELECT (SELECT count(*) FROM base_rows) > 0 AS has_baseline)
"""


def periods_sql(gap: int = 300) -> list[str]:
    """CTEs: bl/bp (latest/previous batched), cb (current re-batched), bb (baseline re-batched)."""
    return [
        PERIODS,
        batched("latest", "bl", gap),
        batched("previous", "bp", gap),
        batched("cur_rows", "cb", gap),
        PERIODS_TAIL,
        batched("base_rows", "bb", gap),
    ]


FEEDS = f"""
bk_raw AS (
  SELECT d.ProductID, d.checkin_date AS CheckInDate,
         CAST(floor(d.search_volume) % 3 + 1 AS DOUBLE) AS booking_count
  FROM demand_rows d
  WHERE d.event_type = 'purchase'
),
bk AS (
  SELECT ProductID, CheckInDate AS checkin_date, sum(coalesce(booking_count, 0.0)) AS Bookings
  FROM bk_raw WHERE ProductID IS NOT NULL AND CheckInDate IS NOT NULL GROUP BY ALL
),
ip_raw AS (
  SELECT l_suppkey AS ProductID,
         DATE '2024-01-01' + CAST(l_orderkey % 44 AS INTEGER) AS stay_date,
         CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax - l_discount END AS gap
  FROM lineitem
),
ip AS (
  SELECT ProductID, stay_date AS checkin_date, min(gap) AS Internal_Worst_Gap,
         median(gap) AS Internal_Median_Gap, count(gap) AS Internal_Comparable_Rates,
         count(*) AS Internal_Total_Rates
  FROM ip_raw GROUP BY ALL
),
ota_long AS (
  SELECT s_suppkey AS ProductID, DATE '{OTA_DATES[0]}' + CAST(k AS INTEGER) AS stay_date,
         CASE (s_suppkey + k) % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE)
              ELSE s_acctbal / 1000.0 - 5.0 END AS g
  FROM supplier CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) t(k)
),
ota AS (
  SELECT ProductID, stay_date AS checkin_date, min(g) AS Agoda_Raw_Gap,
         CASE WHEN min(g) IS NULL THEN NULL ELSE greatest(-min(g), 0.0) END AS Agoda_Price_Disadvantage
  FROM ota_long GROUP BY ALL
)"""

FUNNEL_DOUBLES = {
    "hotness_score", "trend_momentum", "Raw_Destination_Search", "view_volume",
    "Destination_Searches", "Bookings", "Internal_Worst_Gap", "Internal_Median_Gap",
    "Agoda_Raw_Gap", "Agoda_Price_Disadvantage", "Views_per_Search", "Search_to_Booking",
    "Internal_Comparable_Coverage", "Previous_Views", "Previous_Destination_Searches",
    "Comparable_Views", "Previous_Comparable_Views", "Comparable_Destination_Searches",
    "Previous_Comparable_Destination_Searches", "Destination_Search_Change", "View_Change",
}

FUNNEL = """
fn0 AS (
  SELECT h.ProductID, h.checkin_date, h.snapshot_at, h.hotness_score, h.trend_momentum,
         h.search_volume AS Raw_Destination_Search, h.view_volume, h.Interval_Count,
         h.ProductName, h.Destination, h.check_status,
         d.Destination_Search_Snapshot, d.Destination_Searches, d.Destination_Intervals,
         coalesce(bk.Bookings, 0.0) AS Bookings,
         ip.Internal_Worst_Gap, ip.Internal_Median_Gap, ip.Internal_Comparable_Rates, ip.Internal_Total_Rates,
         ota.Agoda_Raw_Gap, ota.Agoda_Price_Disadvantage,
         ph.view_volume AS Previous_Views, ph.Interval_Count AS Previous_View_Intervals,
         pd.Destination_Search_Snapshot AS Previous_Destination_Search_Snapshot,
         pd.Destination_Searches AS Previous_Destination_Searches,
         pd.Destination_Intervals AS Previous_Destination_Intervals
  FROM ch h
  LEFT JOIN cd d ON h.Destination = d.Destination AND h.checkin_date = d.checkin_date
  LEFT JOIN bk ON h.ProductID = bk.ProductID AND h.checkin_date = bk.checkin_date
  LEFT JOIN ip ON h.ProductID = ip.ProductID AND h.checkin_date = ip.checkin_date
  LEFT JOIN ota ON h.ProductID = ota.ProductID AND h.checkin_date = ota.checkin_date
  LEFT JOIN ph ON h.ProductID = ph.ProductID AND h.checkin_date = ph.checkin_date
  LEFT JOIN pd ON h.Destination = pd.Destination AND h.checkin_date = pd.checkin_date
),
fn1 AS (
  SELECT *,
    CASE WHEN Destination_Searches > 0 THEN view_volume / Destination_Searches END AS Views_per_Search,
    CASE WHEN view_volume > 0 THEN Bookings / view_volume END AS Search_to_Booking,
    CASE WHEN Internal_Total_Rates > 0 THEN Internal_Comparable_Rates / Internal_Total_Rates END
      AS Internal_Comparable_Coverage,
    CASE WHEN Previous_View_Intervals IS NOT NULL THEN least(Interval_Count, Previous_View_Intervals) END
      AS Comparable_View_Intervals,
    CASE WHEN Destination_Intervals IS NOT NULL AND Previous_Destination_Intervals IS NOT NULL
         THEN least(Destination_Intervals, Previous_Destination_Intervals) END
      AS Comparable_Destination_Intervals
  FROM fn0
),
fn2 AS (
  SELECT *,
    view_volume / Interval_Count * Comparable_View_Intervals AS Comparable_Views,
    Previous_Views / Previous_View_Intervals * Comparable_View_Intervals AS Previous_Comparable_Views,
    Destination_Searches / Destination_Intervals * Comparable_Destination_Intervals
      AS Comparable_Destination_Searches,
    Previous_Destination_Searches / Previous_Destination_Intervals * Comparable_Destination_Intervals
      AS Previous_Comparable_Destination_Searches
  FROM fn1
),
fn3 AS (
  SELECT *,
    Comparable_Destination_Searches - Previous_Comparable_Destination_Searches AS Destination_Search_Change,
    Comparable_Views - Previous_Comparable_Views AS View_Change
  FROM fn2
),
funnel AS (
  SELECT *,
    CASE WHEN NOT (SELECT has_baseline FROM has_base) THEN 'No baseline'
         WHEN Previous_Views IS NULL OR check_status = 'new entry' THEN 'New'
         WHEN View_Change > 0 THEN 'Up'
         WHEN View_Change < 0 THEN 'Down'
         ELSE 'No change' END AS Upload_Change_Status
  FROM fn3
)"""


def funnel_sql(gap: int = 300) -> list[str]:
    return [
        DEMAND_ROWS, LATEST, PREVIOUS, *periods_sql(gap),
        hotel_checkin("cb", "ch"), destination_checkin("cb", "cd"),
        hotel_checkin("bb", "ph"), destination_checkin("bb", "pd"),
        FEEDS, FUNNEL,
    ]


SUMMARY = """
so AS (
  SELECT * EXCLUDE (_rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY Observation_Batch, ProductID, checkin_date
                                 ORDER BY snapshot_at DESC, load_seq DESC, row_seq DESC) AS _rn
    FROM cb WHERE ProductID IS NOT NULL) WHERE _rn = 1
),
sc AS (
  SELECT ProductID, checkin_date, avg(hotness_score) AS h, avg(trend_momentum) AS t,
         coalesce(sum(view_volume), 0.0) AS v, max(snapshot_at) AS s
  FROM so WHERE checkin_date IS NOT NULL GROUP BY ALL
),
s_dates AS (
  SELECT ProductID, avg(h) AS Current_Hotness, max(h) AS Peak_Hotness, avg(h) AS Avg_Hotness,
         avg(t) AS Current_Trend, sum(v) AS Current_Views, max(v) AS Peak_CheckIn_Views,
         max(s) AS Latest_Snapshot
  FROM sc GROUP BY ALL
),
s_peak AS (
  SELECT ProductID, checkin_date AS Peak_CheckIn_Date FROM (
    SELECT ProductID, checkin_date,
           row_number() OVER (PARTITION BY ProductID ORDER BY v DESC, checkin_date DESC) AS rk
    FROM sc) WHERE rk = 1
),
s_ivals AS (
  SELECT ProductID, count_if(view_volume > 0) AS Active_View_Intervals,
         count_if(check_status = 'modify') AS Modification_Count,
         max(CASE WHEN check_status = 'modify' THEN snapshot_at END) AS Last_Modified_At
  FROM so GROUP BY ALL
),
s_name AS (
  SELECT ProductID, ProductName FROM (
    SELECT ProductID, ProductName,
           row_number() OVER (PARTITION BY ProductID ORDER BY snapshot_at DESC,
             (checkin_date IS NULL) DESC, checkin_date DESC, load_seq DESC, row_seq DESC) AS rk
    FROM so) WHERE rk = 1
),
s0 AS (
  SELECT d.*, n.ProductName, i.Active_View_Intervals, i.Modification_Count, i.Last_Modified_At,
         p.Peak_CheckIn_Date
  FROM s_dates d JOIN s_ivals i USING (ProductID) JOIN s_name n USING (ProductID)
  LEFT JOIN s_peak p USING (ProductID)
),
s_max AS (
  SELECT max(greatest(coalesce(Current_Views, 0.0), 0.0)) AS mv,
         max(greatest(coalesce(CAST(Active_View_Intervals AS DOUBLE), 0.0), 0.0)) AS ma
  FROM s0
),
summary AS (
  SELECT s0.*, round_even((coalesce(Current_Hotness, 0.0) * 40 + coalesce(Current_Trend, 0.0) * 20
      + (CASE WHEN coalesce(m.mv, 0) = 0 THEN 0.0 ELSE greatest(coalesce(Current_Views, 0.0), 0.0) / m.mv * 100 END) * 0.20
      + (CASE WHEN coalesce(m.ma, 0) = 0 THEN 0.0
              ELSE greatest(coalesce(CAST(Active_View_Intervals AS DOUBLE), 0.0), 0.0) / m.ma * 100 END) * 0.20
    ) * 100, 0) / 100 AS Demand_Score
  FROM s0, s_max m
)"""

SUMMARY_COLUMNS = [
    "ProductID", "Current_Hotness", "Peak_Hotness", "Avg_Hotness", "Current_Trend",
    "Current_Views", "Peak_CheckIn_Views", "Latest_Snapshot", "ProductName",
    "Active_View_Intervals", "Modification_Count", "Last_Modified_At",
    "Peak_CheckIn_Date", "Demand_Score",
]
SUMMARY_DOUBLES = {
    "Current_Hotness", "Peak_Hotness", "Avg_Hotness", "Current_Trend", "Current_Views",
    "Peak_CheckIn_Views", "Demand_Score",
}


def status_norm(col: str) -> str:
    s = f"lower(trim(CAST({col} AS VARCHAR)))"
    return (f"CASE WHEN {col} IS NULL OR {s} IN ('nan', 'null', '') THEN 'Unknown' "
            f"ELSE array_to_string(list_transform(string_split({s}, ' '), "
            f"lambda w: upper(w[1:1]) || w[2:]), ' ') END")


ENGINE = f"""
master AS (
  SELECT c.c_custkey AS ProductID, c.c_name AS ProductName, n.n_name AS Destination,
         c.c_mktsegment AS "HotelType Short", r.r_name AS Region, c.c_custkey AS row_seq
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
m1 AS (
  SELECT * EXCLUDE (rk) FROM (
    SELECT *, row_number() OVER (PARTITION BY ProductID ORDER BY row_seq DESC) AS rk FROM master
    WHERE ProductID IS NOT NULL) WHERE rk = 1
),
perf AS (
  SELECT o_custkey AS ProductID, {AGODA_CASE.replace('o_custkey', 'o_custkey')} AS "Agoda Status",
         {CTRIP_CASE} AS "Ctrip Status",
         coalesce(CAST(o_totalprice AS DOUBLE), 0.0) AS Revenue,
         coalesce(CAST(o_orderkey % 40 AS DOUBLE), 0.0) AS "B2B2C RN", o_orderkey AS row_seq
  FROM orders
),
p1 AS (
  SELECT * EXCLUDE (rk, row_seq) FROM (
    SELECT *, row_number() OVER (PARTITION BY ProductID ORDER BY Revenue DESC, "B2B2C RN" DESC, row_seq DESC) AS rk
    FROM perf WHERE ProductID IS NOT NULL) WHERE rk = 1
),
roll AS (
  SELECT ProductID, max(Destination_Searches) AS Destination_Search_Context,
         coalesce(sum(view_volume), 0.0) AS Funnel_Views, coalesce(sum(Bookings), 0.0) AS Funnel_Bookings,
         min(Internal_Worst_Gap) AS Internal_Worst_Gap, median(Internal_Median_Gap) AS Internal_Median_Gap,
         CAST(coalesce(sum(Internal_Comparable_Rates), 0) AS BIGINT) AS Internal_Comparable_Rates,
         CAST(coalesce(sum(Internal_Total_Rates), 0) AS BIGINT) AS Internal_Total_Rates,
         max(Agoda_Price_Disadvantage) AS Agoda_Price_Disadvantage,
         count(Agoda_Raw_Gap) AS Agoda_Comparable_Dates
  FROM funnel GROUP BY ALL
),
roll2 AS (
  SELECT *, CASE WHEN Destination_Search_Context > 0 THEN Funnel_Views / Destination_Search_Context END
              AS Views_per_Search,
            CASE WHEN Funnel_Views > 0 THEN Funnel_Bookings / Funnel_Views END AS Search_to_Booking
  FROM roll
),
e0 AS (
  SELECT s.* EXCLUDE (ProductName), coalesce(m.ProductName, s.ProductName) AS ProductName,
         m.Destination, m."HotelType Short", m.Region,
         {status_norm('p."Agoda Status"')} AS "Agoda Status",
         {status_norm('p."Ctrip Status"')} AS "Ctrip Status",
         coalesce(p.Revenue, 0.0) AS Revenue, coalesce(p."B2B2C RN", 0.0) AS "B2B2C RN",
         r.* EXCLUDE (ProductID)
  FROM summary s LEFT JOIN m1 m USING (ProductID) LEFT JOIN p1 p USING (ProductID)
  LEFT JOIN roll2 r USING (ProductID)
),
e_max AS (SELECT max(greatest(Revenue, 0.0)) AS mr, max(greatest("B2B2C RN", 0.0)) AS mn FROM e0),
e1 AS (
  SELECT e0.*,
    round_even((CASE WHEN coalesce(x.mr, 0) = 0 THEN 0.0 ELSE greatest(Revenue, 0.0) / x.mr * 100 END) * 100, 0) / 100
      AS "Revenue Score",
    round_even((CASE WHEN coalesce(x.mn, 0) = 0 THEN 0.0 ELSE greatest("B2B2C RN", 0.0) / x.mn * 100 END) * 100, 0) / 100
      AS "RN Score",
    CASE "Agoda Status" WHEN 'Mapped' THEN 100.0 WHEN 'No Room' THEN 70.0 WHEN 'Not Live' THEN 40.0 ELSE 0.0 END
      AS "Agoda Score",
    CASE "Ctrip Status" WHEN 'Mapped' THEN 100.0 WHEN 'Not Live' THEN 40.0 ELSE 0.0 END AS "Ctrip Score"
  FROM e0, e_max x
),
e2 AS (SELECT *, round_even(("Agoda Score" + "Ctrip Score") / 2 * 100, 0) / 100 AS "Mapping Score" FROM e1),
e3 AS (
  SELECT *,
    round_even(("Revenue Score" * 0.5 + "RN Score" * 0.3 + Demand_Score * 0.2) * 100, 0) / 100 AS "Business Score",
    round_even((Demand_Score * 0.4 + "Revenue Score" * 0.25 + "RN Score" * 0.15
      + least(greatest(coalesce(Current_Trend, 0.0), 0.0), 1.0) * 100 * 0.1
      + (100 - "Mapping Score") * 0.1) * 100, 0) / 100 AS "Opportunity Index"
  FROM e2
),
e4 AS (
  SELECT *, row_number() OVER (ORDER BY "Opportunity Index" DESC NULLS LAST, ProductID ASC) AS "Commercial Rank"
  FROM e3
),
e5 AS (
  SELECT *,
    CASE WHEN "Commercial Rank" <= 50 THEN 'Critical' WHEN "Commercial Rank" <= 200 THEN 'High'
         WHEN "Commercial Rank" <= 500 THEN 'Medium' ELSE 'Low' END AS Priority,
    CASE WHEN "Agoda Status" = 'Not Mapped' THEN 'Map Hotel to Agoda'
         WHEN "Agoda Status" = 'No Room' THEN 'Complete Room-Type Mapping'
         WHEN "Agoda Status" = 'Not Live' THEN 'Activate Agoda'
         WHEN Internal_Worst_Gap < 0 THEN 'Fix Internal Rate Parity'
         WHEN Agoda_Price_Disadvantage > 0 THEN 'Review Agoda Rate Competitiveness'
         WHEN coalesce(Funnel_Views, 0) > 0 AND coalesce(Funnel_Bookings, 0) = 0
              AND Demand_Score >= (SELECT median(Demand_Score) FROM e3) THEN 'Investigate Booking Conversion'
         WHEN "Ctrip Status" = 'Not Mapped' THEN 'Expand to Ctrip'
         WHEN "Ctrip Status" = 'Not Live' THEN 'Activate Ctrip'
         WHEN "Opportunity Index" >= 70 THEN 'Protect Commercial Performance'
         ELSE 'Monitor' END AS Action
  FROM e4
),
engine AS (
  SELECT *,
    CASE Action
      WHEN 'Map Hotel to Agoda' THEN 'Demand exists, but hotel-level mapping is missing on Agoda.'
      WHEN 'Complete Room-Type Mapping' THEN 'Hotel-level mapping exists, but room types are not mapped.'
      WHEN 'Activate Agoda' THEN 'Agoda connectivity exists, but the hotel is not live.'
      WHEN 'Fix Internal Rate Parity' THEN 'Our rate is more expensive than a comparable partner rate.'
      WHEN 'Review Agoda Rate Competitiveness' THEN 'Agoda reports a price disadvantage; 0% is cheapest.'
      WHEN 'Investigate Booking Conversion' THEN 'Demand exists, but no booking is matched to the current check-in demand.'
      WHEN 'Expand to Ctrip' THEN 'The hotel has demand but is not mapped on Ctrip.'
      WHEN 'Activate Ctrip' THEN 'Ctrip connectivity exists, but the hotel is not live.'
      WHEN 'Protect Commercial Performance' THEN 'This is a high-value hotel; monitor its commercial performance.'
      WHEN 'Monitor' THEN 'No immediate distribution issue requires action.' END AS Reason
  FROM e5
)"""

ENGINE_COLUMNS = SUMMARY_COLUMNS + [
    "Destination", "HotelType Short", "Region", "Agoda Status", "Ctrip Status", "Revenue",
    "B2B2C RN", "Destination_Search_Context", "Funnel_Views", "Funnel_Bookings",
    "Internal_Worst_Gap", "Internal_Median_Gap", "Internal_Comparable_Rates",
    "Internal_Total_Rates", "Agoda_Price_Disadvantage", "Agoda_Comparable_Dates",
    "Views_per_Search", "Search_to_Booking", "Revenue Score", "RN Score", "Agoda Score",
    "Ctrip Score", "Mapping Score", "Business Score", "Opportunity Index", "Commercial Rank",
    "Priority", "Action", "Reason",
]
ENGINE_DOUBLES = SUMMARY_DOUBLES | {
    "Revenue", "B2B2C RN", "Destination_Search_Context", "Funnel_Views", "Funnel_Bookings",
    "Internal_Worst_Gap", "Internal_Median_Gap", "Agoda_Price_Disadvantage", "Views_per_Search",
    "Search_to_Booking", "Revenue Score", "RN Score", "Agoda Score", "Ctrip Score",
    "Mapping Score", "Business Score", "Opportunity Index",
}


DETAIL = """
detail AS (
  SELECT f.*, e.Region, e."HotelType Short"
  FROM funnel f LEFT JOIN (SELECT ProductID, Region, "HotelType Short" FROM engine) e USING (ProductID)
  WHERE f.checkin_date IS NOT NULL
),
dest_days AS (
  SELECT checkin_date, Destination, max(Destination_Searches) AS DS,
         max(Previous_Destination_Searches) AS PDS,
         max(Previous_Comparable_Destination_Searches) AS PCDS,
         max(Destination_Search_Change) AS DSC
  FROM detail GROUP BY ALL
),
dm_s AS (SELECT checkin_date, coalesce(sum(DS), 0.0) AS Searches FROM dest_days GROUP BY ALL),
dm_h AS (
  SELECT checkin_date, coalesce(sum(view_volume), 0.0) AS Views, count(DISTINCT ProductID) AS Hotels
  FROM detail GROUP BY ALL
),
dm0 AS (SELECT * FROM dm_s FULL OUTER JOIN dm_h USING (checkin_date)),
dm_q AS (SELECT quantile_cont(Searches, [0.4, 0.75, 0.9]) AS q FROM dm0),
daily AS (
  SELECT dm0.*, CASE WHEN Searches >= q[3] THEN 'Very High' WHEN Searches >= q[2] THEN 'High'
                     WHEN Searches >= q[1] THEN 'Medium' ELSE 'Low' END AS "Demand Level"
  FROM dm0, dm_q
),
dsig AS (
  SELECT checkin_date, Destination,
    CASE WHEN PDS IS NULL THEN 'New demand'
         WHEN (CASE WHEN PCDS > 0 THEN DSC / PCDS END) >= 0.25 THEN 'Critical surge'
         WHEN (CASE WHEN PCDS > 0 THEN DSC / PCDS END) >= 0.10 THEN 'High increase'
         WHEN (CASE WHEN PCDS > 0 THEN DSC / PCDS END) <= -0.10 THEN 'Declining'
         ELSE 'Stable' END AS "Destination Signal"
  FROM dest_days
),
hq75 AS (SELECT checkin_date, quantile_cont(view_volume, 0.75) AS q75 FROM detail GROUP BY ALL),
hsig0 AS (
  SELECT d.*, CASE WHEN Previous_Comparable_Views > 0 THEN View_Change / Previous_Comparable_Views END
           AS "View Change %"
  FROM detail d
),
hsig AS (
  SELECT h.*,
    CASE WHEN h.Previous_Views IS NULL OR h.check_status = 'new entry' THEN 'New interest'
         WHEN h."View Change %" >= 0.25 THEN 'Critical surge'
         WHEN h."View Change %" >= 0.10 THEN 'High increase'
         WHEN h."View Change %" <= -0.10 THEN 'Declining'
         ELSE 'Stable' END AS "Hotel Signal",
    s."Destination Signal",
    coalesce(s."Destination Signal" IN ('Critical surge', 'High increase', 'New demand')
      AND (coalesce(h.View_Change > 0, FALSE) OR coalesce(h.view_volume >= q.q75, FALSE)), FALSE) AS Action
  FROM hsig0 h
  LEFT JOIN dsig s ON h.checkin_date = s.checkin_date AND h.Destination IS NOT DISTINCT FROM s.Destination
  LEFT JOIN hq75 q ON h.checkin_date = q.checkin_date
)"""

HISTORY_CTES = """
hist_h AS (
  SELECT ProductID, checkin_date, snapshot_at AS Last_Observed_At, hotness_score, trend_momentum,
         search_volume, view_volume AS Total_Observed_Views, Interval_Count AS Historical_View_Intervals,
         ProductName, Destination, check_status FROM hh
),
hist_d AS (
  SELECT Destination, checkin_date, Destination_Search_Snapshot AS Last_Observed_At,
         Destination_Searches AS Total_Observed_Searches, Destination_Intervals AS Historical_Search_Intervals
  FROM hd
)"""


def history_sql(gap: int = 300) -> list[str]:
    """CTEs hist_h / hist_d (A4) from the union of previous and latest."""
    return [
        """
hist_union AS (SELECT *, 0 AS _src FROM previous UNION ALL SELECT *, 1 AS _src FROM latest),
hist AS (
  SELECT * EXCLUDE (_rn, _src) FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_at, checkin_date, ProductID
                                 ORDER BY _src DESC, load_seq DESC, row_seq DESC) AS _rn
    FROM hist_union) WHERE _rn = 1
)""",
        batched("hist", "hb", gap),
        hotel_checkin("hb", "hh"),
        destination_checkin("hb", "hd"),
        HISTORY_CTES,
    ]


def full_chain(gap: int = 300) -> list[str]:
    return [*funnel_sql(gap), SUMMARY, ENGINE, *history_sql(gap), DETAIL]
