"""Hotel engine: D1-D3 dimensions, A7 roll-up, S1-S8 scores, W1/W2 rank, S7 action."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from staylens.functions import columns as C
from staylens.operators.facts import latest_per_key
from staylens.operators.joins import assert_unique
from staylens.operators.ranking import global_row_number
from staylens.operators.summary import max_scale
from staylens.session import cut_lineage


@dataclass(frozen=True)
class Weights:
    """S6 weights (the original's configuration values)."""

    demand: float = 0.40
    revenue: float = 0.25
    rn: float = 0.15
    trend: float = 0.10
    mapping: float = 0.10


# Partner-status scores, priority bands, rules and reasons.
AGODA_SCORES = {"Mapped": 100, "No Room": 70, "Not Live": 40, "Not Mapped": 0, "Unknown": 0}
CTRIP_SCORES = {"Mapped": 100, "Not Live": 40, "Not Mapped": 0, "Unknown": 0}
PRIORITY_BANDS = [(50, "Critical"), (200, "High"), (500, "Medium")]
REASONS = {
    "Map Hotel to Agoda": "Demand exists, but hotel-level mapping is missing on Agoda.",
    "Complete Room-Type Mapping": "Hotel-level mapping exists, but room types are not mapped.",
    "Activate Agoda": "Agoda connectivity exists, but the hotel is not live.",
    "Fix Internal Rate Parity": "Our rate is more expensive than a comparable partner rate.",
    "Review Agoda Rate Competitiveness": "Agoda reports a price disadvantage; 0% is cheapest.",
    "Investigate Booking Conversion": "Demand exists, but no booking is matched to the current check-in demand.",
    "Expand to Ctrip": "The hotel has demand but is not mapped on Ctrip.",
    "Activate Ctrip": "Ctrip connectivity exists, but the hotel is not live.",
    "Protect Commercial Performance": "This is a high-value hotel; monitor its commercial performance.",
    "Monitor": "No immediate distribution issue requires action.",
}
SUMMARY_SENTENCES = [
    "This hotel requires immediate attention.",
    "Customer demand is currently strong.",
    "Agoda mapping is the highest priority.",
    "Revenue contribution is significant.",
]


def dedupe_master(master: DataFrame) -> DataFrame:
    """One row per ProductID, the last in input order."""
    rows = master.withColumn("ProductID", C.as_long(master, "ProductID")).where(F.col("ProductID").isNotNull())
    return latest_per_key(rows, ["ProductID"], ["row_seq"])


def dedupe_performance(performance: DataFrame) -> DataFrame:
    """Per ProductID the row with the highest (Revenue, RN); NULL -> 0 first."""
    rows = performance.select(
        C.as_long(performance, "ProductID").alias("ProductID"),
        "ProductName",
        "`Agoda Status`",
        "`Ctrip Status`",
        F.coalesce(C.as_double(performance, "Revenue"), F.lit(0.0)).alias("Revenue"),
        F.coalesce(C.as_double(performance, "B2B2C RN"), F.lit(0.0)).alias("B2B2C RN"),
        "row_seq",
    ).where(F.col("ProductID").isNotNull())
    return latest_per_key(rows, ["ProductID"], ["Revenue", "B2B2C RN", "row_seq"])


def hotel_master_view(master: DataFrame, performance: DataFrame) -> DataFrame:
    """D3: deduplicated master with partner statuses of the deduplicated performance.

    Unlike D2 this copy sorts the raw numbers (NULL revenue sorts last, so
    it wins the keep-last), as the original dashboard does.
    """
    m = dedupe_master(master).drop("row_seq")
    rev, rn = C.as_double(performance, "Revenue"), C.as_double(performance, "B2B2C RN")
    rows = performance.select(
        C.as_long(performance, "ProductID").alias("ProductID"),
        "`Agoda Status`",
        "`Ctrip Status`",
        rev.isNull().alias("_rn"),
        rev.alias("_rev"),
        rn.isNull().alias("_bn"),
        rn.alias("_b"),
        "row_seq",
    ).where(F.col("ProductID").isNotNull())
    p = latest_per_key(rows, ["ProductID"], ["_rn", "_rev", "_bn", "_b", "row_seq"]).select(
        "ProductID", "Agoda Status", "Ctrip Status"
    )
    return m.join(p, on="ProductID", how="left")


def funnel_rollup(funnel: DataFrame) -> DataFrame:
    """Per hotel roll-up of the funnel."""
    r = funnel.groupBy("ProductID").agg(
        F.max("Destination_Searches").alias("Destination_Search_Context"),
        C.sum0("view_volume").alias("Funnel_Views"),
        C.sum0("Bookings").alias("Funnel_Bookings"),
        F.min("Internal_Worst_Gap").alias("Internal_Worst_Gap"),
        F.median("Internal_Median_Gap").alias("Internal_Median_Gap"),
        F.coalesce(F.sum("Internal_Comparable_Rates"), F.lit(0)).alias("Internal_Comparable_Rates"),
        F.coalesce(F.sum("Internal_Total_Rates"), F.lit(0)).alias("Internal_Total_Rates"),
        F.max("Agoda_Price_Disadvantage").alias("Agoda_Price_Disadvantage"),
        F.count("Agoda_Raw_Gap").alias("Agoda_Comparable_Dates"),
    )
    return r.withColumns(
        {
            "Views_per_Search": C.ratio_if_positive("Funnel_Views", "Destination_Search_Context"),
            "Search_to_Booking": C.ratio_if_positive("Funnel_Bookings", "Funnel_Views"),
        }
    )


def _lookup(column: str, table: dict[str, int]) -> F.Column:
    expr = None
    for label, score in table.items():
        cond = F.col(f"`{column}`") == label
        expr = F.when(cond, F.lit(float(score))) if expr is None else expr.when(cond, F.lit(float(score)))
    return expr.otherwise(F.lit(0.0))


def priority_band(rank: F.Column) -> F.Column:
    """Right-closed bands (0,50] Critical, (50,200] High, (200,500] Medium, else Low."""
    expr = None
    for upper, label in PRIORITY_BANDS:
        expr = F.when(rank <= upper, label) if expr is None else expr.when(rank <= upper, label)
    return expr.otherwise("Low")


def recommend_action(engine: DataFrame) -> F.Column:
    """First matching rule, default Monitor."""
    agoda, ctrip = F.col("`Agoda Status`"), F.col("`Ctrip Status`")
    views = F.coalesce(F.col("Funnel_Views"), F.lit(0.0)) if "Funnel_Views" in engine.columns else F.lit(0.0)
    bookings = F.coalesce(F.col("Funnel_Bookings"), F.lit(0.0)) if "Funnel_Bookings" in engine.columns else F.lit(0.0)
    gap = F.col("Internal_Worst_Gap") if "Internal_Worst_Gap" in engine.columns else F.lit(None)
    disadvantage = (
        F.col("Agoda_Price_Disadvantage") if "Agoda_Price_Disadvantage" in engine.columns else F.lit(None)
    )
    median_demand = engine.agg(F.median("Demand_Score")).scalar()
    return (
        F.when(agoda == "Not Mapped", "Map Hotel to Agoda")
        .when(agoda == "No Room", "Complete Room-Type Mapping")
        .when(agoda == "Not Live", "Activate Agoda")
        .when(gap < 0, "Fix Internal Rate Parity")
        .when(disadvantage > 0, "Review Agoda Rate Competitiveness")
        .when((views > 0) & (bookings == 0) & (F.col("Demand_Score") >= median_demand), "Investigate Booking Conversion")
        .when(ctrip == "Not Mapped", "Expand to Ctrip")
        .when(ctrip == "Not Live", "Activate Ctrip")
        .when(F.col("`Opportunity Index`") >= 70, "Protect Commercial Performance")
        .otherwise("Monitor")
    )


def reason(action: F.Column) -> F.Column:
    expr = None
    for label, text in REASONS.items():
        expr = F.when(action == label, text) if expr is None else expr.when(action == label, text)
    return expr


def build_engine(
    summary: DataFrame,
    master: DataFrame,
    performance: DataFrame,
    funnel: DataFrame | None = None,
    weights: Weights = Weights(),
    sheets_unique: bool = False,
) -> DataFrame:
    """Engine table: one ranked row per hotel of the summary.

    ``sheets_unique``: the caller's master and performance have one row per
    hotel; they are not deduplicated, and a repeated hotel fails the run (J17).
    """
    if sheets_unique:
        master, performance = (assert_unique(t, ["ProductID"], name) for t, name in ((master, "master"), (performance, "performance")))
    m = (master if sheets_unique else dedupe_master(master)).select(
        "ProductID", F.col("ProductName").alias("_master_name"), "Destination", "`HotelType Short`", "Region"
    )
    p = (performance if sheets_unique else dedupe_performance(performance)).drop("ProductName", "row_seq")
    e = summary.join(m, on="ProductID", how="left").withColumn(
        "ProductName", F.coalesce("_master_name", "ProductName")
    ).drop("_master_name")
    e = e.join(p, on="ProductID", how="left")
    if funnel is not None:
        e = e.join(funnel_rollup(funnel), on="ProductID", how="left")
    # one row per hotel from here on: write it once so the global maxima,
    # the median and the rank below plan over a plain scan
    e = cut_lineage(e, "engine_base").withColumns(
        {
            "Agoda Status": C.normalise_status("`Agoda Status`"),
            "Ctrip Status": C.normalise_status("`Ctrip Status`"),
            "Revenue": F.coalesce("Revenue", F.lit(0.0)),
            "B2B2C RN": F.coalesce("`B2B2C RN`", F.lit(0.0)),
        }
    )
    e = e.withColumns(
        {
            "Revenue Score": C.rint2(max_scale(e, "Revenue")),
            "RN Score": C.rint2(max_scale(e, "B2B2C RN")),
            "Agoda Score": _lookup("Agoda Status", AGODA_SCORES),
            "Ctrip Score": _lookup("Ctrip Status", CTRIP_SCORES),
        }
    )
    e = e.withColumn("Mapping Score", C.rint2((F.col("`Agoda Score`") + F.col("`Ctrip Score`")) / 2))
    e = e.withColumns(
        {
            "Business Score": C.rint2(
                F.col("`Revenue Score`") * 0.5 + F.col("`RN Score`") * 0.3 + F.col("Demand_Score") * 0.2
            ),
            "Opportunity Index": C.rint2(
                F.col("Demand_Score") * weights.demand
                + F.col("`Revenue Score`") * weights.revenue
                + F.col("`RN Score`") * weights.rn
                + C.clip01(F.coalesce("Current_Trend", F.lit(0.0))) * 100 * weights.trend
                + (100 - F.col("`Mapping Score`")) * weights.mapping
            ),
        }
    )
    e = global_row_number(
        e, [F.col("`Opportunity Index`").desc_nulls_last(), F.col("ProductID").asc()], "Commercial Rank"
    )
    e = e.withColumn("Priority", priority_band(F.col("`Commercial Rank`")))
    e = e.withColumn("Action", recommend_action(e))
    return e.withColumn("Reason", reason(F.col("Action")))


def scores_v2(engine: DataFrame) -> DataFrame:
    """The older score set (plain max-ratios, 50 points per 'Mapped')."""
    rev_max = engine.agg(F.max("Revenue")).scalar()
    rn_max = engine.agg(F.max("`B2B2C RN`")).scalar()
    e = engine.withColumns(
        {
            "Revenue Score v2": C.rint2(C.guarded_div(F.col("Revenue"), rev_max) * 100),
            "RN Score v2": C.rint2(C.guarded_div(F.col("`B2B2C RN`"), rn_max) * 100),
            "Mapping Score v2": (
                F.when(F.col("`Agoda Status`") == "Mapped", 50).otherwise(0)
                + F.when(F.col("`Ctrip Status`") == "Mapped", 50).otherwise(0)
            ).cast("bigint"),
        }
    )
    e = e.withColumn(
        "Business Score v2",
        C.rint2(F.col("`Revenue Score v2`") * 0.5 + F.col("`RN Score v2`") * 0.3 + F.col("Demand_Score") * 0.2),
    )
    return e.withColumn(
        "Opportunity Score v2",
        C.rint2(F.col("`Business Score v2`") * (100 - F.col("`Mapping Score v2`")) / 100),
    )


def hotel_summary_text(engine: DataFrame) -> F.Column:
    """PRJ8: sentences by condition, always ending with the recommended action."""
    return F.concat_ws(
        " ",
        F.when(F.col("Priority") == "Critical", SUMMARY_SENTENCES[0]),
        F.when(F.col("Demand_Score") > 70, SUMMARY_SENTENCES[1]),
        F.when(F.col("`Agoda Status`") != "Mapped", SUMMARY_SENTENCES[2]),
        F.when(F.col("Revenue") > 500000, SUMMARY_SENTENCES[3]),
        F.concat(F.lit("Recommended action: "), F.col("Action"), F.lit(".")),
    )
