import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DoubleType, LongType, StringType, StructField, StructType,
                               TimestampNTZType, IntegerType)

DEMAND_SCHEMA = StructType([
    StructField("snapshot_at", TimestampNTZType()), StructField("checkin_date", DateType()),
    StructField("ProductID", LongType()), StructField("ProductName", StringType()),
    StructField("Destination", StringType()), StructField("trend_momentum", DoubleType()),
    StructField("hotness_score", DoubleType()), StructField("check_status", StringType()),
    StructField("search_volume", DoubleType()), StructField("view_volume", DoubleType()),
    StructField("load_seq", IntegerType()), StructField("row_seq", LongType()),
])

D = dt.date(2026, 8, 19)


def ts(hms: str, day: dt.date = D) -> dt.datetime:
    h, m, *s = (int(x) for x in hms.split(":"))
    return dt.datetime(day.year, day.month, day.day, h, m, s[0] if s else 0)


def demand(spark, rows):
    """rows: dicts with any of the demand columns; defaults fill the rest."""
    out = []
    for i, r in enumerate(rows):
        base = {"snapshot_at": None, "checkin_date": D, "ProductID": 1, "ProductName": "Hotel",
                "Destination": "Bangkok", "trend_momentum": 0.1, "hotness_score": 0.5,
                "check_status": "continues", "search_volume": 100.0, "view_volume": 1.0,
                "load_seq": 0, "row_seq": i}
        base.update(r)
        out.append(tuple(base[f.name] for f in DEMAND_SCHEMA.fields))
    return spark.createDataFrame(out, DEMAND_SCHEMA)


def rows(df, *cols, order=None):
    df = df.select(*cols) if cols else df
    data = [tuple(r) for r in df.collect()]
    return sorted(data, key=lambda t: tuple((x is None, str(x)) for x in t))
