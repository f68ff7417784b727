"""Quantiles by counting, worklists without a global sort, run-time key checks, sheets, snapshots, aliases."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMOKE
from helpers import rows
from staylens.functions.columns import round_doubles
from staylens.operators import engine as E, joins, views as V, weeks as W
from staylens.operators.quantiles import group_quantiles
from staylens.plans import publish
from staylens.sources import driver_tables as T, feeds, files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quantiles_match_pandas(spark):
    r = random.Random(6)
    make = [lambda: r.choice([0.0, -0.0, 1.0, 2.0, 3.0]), lambda: r.gauss(0, 1e6), lambda: r.uniform(-1, 1) * 10 ** r.randrange(-300, 300), lambda: float(r.randrange(1000)), lambda: 7.5]
    data = [(g, make[g]() if r.random() < 0.9 else None) for g in range(5) for _ in range(r.choice([1, 2, 57, 400]))] + [(9, None)]
    points = [0.0, 0.2, 0.5, 0.75, 0.8, 0.9, 1.0]
    got = {x.g: list(x._q) for x in group_quantiles(spark.createDataFrame(data, "g int, v double"), ["g"], F.col("v"), points).collect()}
    frame = pd.DataFrame(data, columns=["g", "v"]).dropna()
    want = {g: f["v"].astype(float).quantile(points).tolist() for g, f in frame.groupby("g")}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12, abs=1e-300)
    whole = group_quantiles(spark.createDataFrame(data, "g int, v double"), [], F.col("v"), [0.5]).first()
    assert whole._q[0] == pytest.approx(frame["v"].astype(float).median(), rel=1e-12)
    assert group_quantiles(spark.createDataFrame([], "g int, v double"), ["g"], F.col("v"), points).collect() == []


def test_buckets_never_fall():
    import math

    values = sorted({s * m * 2.0**e for s in (-1, 1) for e in range(-1074, 1023, 37) for m in (1, 1.0625, 1.06249, 1.5)} | {0.0})
    place = lambda v: 0 if v == 0 else math.copysign(math.floor(math.log2(abs(v)) * 16) + 17_300, v)
    places = [place(v) for v in values]
    assert places == sorted(places) and min(p for p, v in zip(places, values) if v > 0) > 0


def week_detail(spark, hotels=450, days=9):
    r = random.Random(8)
    start = dt.date(2026, 8, 17)
    data = [(start + dt.timedelta(days=d), p, f"H{p}", f"D{p % 4}", "R", float(r.choice([0, 0, 5, 9, p % 50])), float(p % 4 * 10 + d)) for d in range(days) for p in range(hotels) if r.random() < 0.8]
    return spark.createDataFrame(data, "checkin_date date, ProductID long, ProductName string, Destination string, Region string, view_volume double, Destination_Searches double")


def test_worklist_is_the_top_of_the_ranked_week(spark):
    detail = week_detail(spark)
    ranked = W.checkin_week_hotels(detail)
    sizes = {x.week_start: x["count"] for x in ranked.groupBy("week_start").count().collect()}
    assert max(sizes.values()) > 200
    short = W.week_worklist(detail, 200)
    columns = sorted(short.columns)
    assert rows(short, *columns) == rows(ranked.where("Priority <= 200"), *columns)
    assert "WindowGroupLimit" in plan(short) and "rangepartitioning" not in plan(short)
    assert rows(W.week_worklist(detail, 3), *columns) == rows(ranked.where("Priority <= 3"), *columns)


def test_metrics_use_no_percentile(spark):
    detail = week_detail(spark, 20)
    for df in (W.week_hotel_metrics(detail), W.week_worklist(detail)):
        assert "percentile" not in plan(df)


def test_repeated_key_fails_with_its_name(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "k long, v string")
    assert rows(joins.repeated_keys(df, ["k"]), "k") == [(2,)]
    with pytest.raises(Exception, match="master: k 2 occurs more than once"):
        joins.assert_unique(df, ["k"], "master").collect()
    once = joins.assert_unique(df.distinct(), ["k"], "master")
    assert rows(once) == rows(df.distinct())
    with pytest.raises(Exception, match="sheet: k NULL, v c occurs more than once"):
        joins.assert_unique(df.unionByName(df.where("k IS NULL")).distinct().unionByName(df.where("k IS NULL")), ["k", "v"], "sheet").collect()


def test_engine_fails_on_a_repeated_master_key(spark):
    from staylens.plans.rebuild import Rebuild, driver_sources

    r = Rebuild(driver_sources(spark, SMOKE), 900)
    master = E.dedupe_master(T.hotel_master(spark, SMOKE))
    performance = E.dedupe_performance(T.hotel_performance(spark, SMOKE))
    build = lambda m: E.build_engine(r.summary, m, performance, sheets_unique=True)
    want = E.build_engine(r.summary, T.hotel_master(spark, SMOKE), T.hotel_performance(spark, SMOKE))
    assert rows(build(master), "ProductID", "`Commercial Rank`") == rows(want, "ProductID", "`Commercial Rank`")
    twice = master.where("ProductID IS NOT NULL").orderBy("ProductID").limit(1)
    key = twice.first().ProductID
    with pytest.raises(Exception, match=f"master: ProductID {key} occurs more than once"):
        build(master.unionByName(twice)).collect()


@pytest.mark.parametrize("title", ["Report, from 1 August", '"quoted, title",,', "", ",,,"])
def test_sheet_with_its_header_on_the_second_line(spark, tmpdir_path, title):
    path = os.path.join(tmpdir_path, "sheet.csv")
    with open(path, "w") as f:
        f.write(title + "\nHotel Id,\"Hotel, name\",2026-08-19,2026-08-20,\n")
        f.writelines(f'{i},"N, {i}",{-i},,x\n' for i in range(1, 400))
    for size in ("128m", "1k"):  # one split, then many
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            sheet = files.land_sheet(spark, path, header_line=1)
            assert sheet.columns == ["Hotel Id", "Hotel, name", "2026-08-19", "2026-08-20", "_c4", "row_seq"]
            got = sheet.orderBy("row_seq").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [tuple(x)[:5] for x in got] == [(str(i), f"N, {i}", str(-i), None, "x") for i in range(1, 400)]
    parity = feeds.ota_parity(files.land_sheet(spark, path))
    assert parity.where("Agoda_Price_Disadvantage > 0").count() == 399 and parity.count() == 798
    with pytest.raises(ValueError, match="no line 900"):
        files.land_sheet(spark, path, header_line=899)


def test_newest_snapshots_prune_folders(spark, tmpdir_path):
    snaps = os.path.join(tmpdir_path, "snaps")
    assert files.newest_snapshots(spark, snaps) is None
    for d in (18, 19, 20):
        publish.save_snapshot(spark.createDataFrame([(d, "x")], "ProductID long, Action string"), snaps, dt.date(2026, 8, d))
        if d == 18:
            assert files.newest_snapshots(spark, snaps).count() == 0  # fewer than two dates
    two = files.newest_snapshots(spark, snaps)
    assert rows(two, "age", "ProductID") == [(1, 20), (2, 19)]
    assert "dynamicpruning" in plan(two)


def test_aliases(spark):
    mapped = spark.createDataFrame([(dt.date(2026, 8, 19), "Buriram", 5.0), (dt.date(2026, 8, 19), "Phuket", 7.0)], "checkin_date date, Destination string, Searches double")
    provinces = spark.createDataFrame([("Buri Ram",), ("Buriram",), ("Phuket",), ("Phuket",), ("Phangnga",), ("Nowhere",)], "province string")
    aliases = V.alias_table(spark)
    got = V.province_demand(mapped, provinces, aliases)
    assert rows(got, "province", "Searches") == [("Buri Ram", 5.0), ("Buriram", 5.0), ("Phuket", 7.0)]
    assert rows(V.unmatched_provinces(mapped, provinces, aliases), "province", "Destination") == [("Nowhere", "Nowhere"), ("Phangnga", "Phang Nga")]
    twice = aliases.unionByName(spark.createDataFrame([("Buri Ram", "Elsewhere")], aliases.schema))
    with pytest.raises(Exception, match="aliases: alias Buri Ram occurs more than once"):
        V.province_demand(mapped, provinces, twice).collect()


def test_week_summaries_merge_by_union(spark):
    """Weeks summarised apart, a batch across the Monday included, compare as weeks summarised together."""
    from helpers import demand

    r = random.Random(3)
    monday = dt.datetime(2026, 8, 17)
    at = [monday + dt.timedelta(seconds=s) for s in (-90, -60, -30, 0, 30, 60)] + [monday + dt.timedelta(minutes=r.randrange(-9000, 9000)) for _ in range(150)]
    df = demand(spark, [{"snapshot_at": a, "ProductID": r.randrange(4), "view_volume": float(i), "search_volume": float(i % 7), "Destination": f"D{r.randrange(2)}"} for i, a in enumerate(at)])
    whole = W.snapshot_week(df, 120)
    parts = [W.week_summaries(df.where(W.monday(F.to_date("snapshot_at")) == F.lit(w)), 120) for w in ("2026-08-10", "2026-08-17")]
    merged = W.compare_weeks(*(parts[0][i].unionByName(parts[1][i]) for i in (0, 1)))
    columns = sorted(whole.columns)
    assert rows(round_doubles(merged), *columns) == rows(round_doubles(whole), *columns) and whole.where("Previous_Views IS NOT NULL").count() > 0
