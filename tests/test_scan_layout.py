"""Scans with rejected rows, tables laid out for their readers, counters of steps, and correlations of many columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.operators import clean, correlate, features
from seriesloom.params import Params
from seriesloom.sources import layout, scan
from seriesloom.sources.series import daily, raw_orders

SF = "/root/testdata/sf0.001"


def test_damaged_lines_are_set_apart_and_none_is_lost(spark, tmp_path):
    good = [f"2024-01-{d:02d} 10:00:00,{100 + d}.5,{d},x{d}" for d in range(1, 29)]
    bad = ["2024-02-30 10:00:00,1.5,3,bad date", "2024-02-01 10:00:00,much,4,bad price", "too,few", "2024-02-01 10:00:00,1,2,3,4,too many", "2024-02-02 10:00:00,,7,", "soon,much,many,all"]
    (tmp_path / "a.csv").write_text("Time,Last,count,note\n" + "\n".join(good) + "\n")
    (tmp_path / "b.csv").write_text("Time,Last,count,note\n" + "\n".join(bad) + "\n")
    found = scan.scan_csv(spark, str(tmp_path))
    assert found.types == {"Time": "timestamp", "Last": "double", "count": "bigint", "note": "string"}
    assert found.rows.count() + found.rejected.count() == len(good) + len(bad)
    reasons = sorted("; ".join(r["reasons"]) for r in found.rejected.collect())
    assert sum("another number" in r for r in reasons) == 2 and "Last is no double" in reasons and "Time is no timestamp" in reasons
    assert any(r.count(" is no ") == 3 for r in reasons)
    assert dict(found.rows.dtypes) == {"Time": "timestamp", "Last": "double", "count": "bigint", "note": "string"}
    assert found.rows.where("Last is null").count() == 1
    assert found.failures["Time"] == 2 and found.failures["Last"] == 2


def test_types_agree_over_files_and_in_other_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("n,caf\xe9\n1,a\n2,b\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("n,caf\xe9\n3.5,\xe9t\xe9\n".encode("latin-1"))
    found = scan.scan_csv(spark, str(tmp_path), encoding="latin-1")
    assert found.types == {"n": "double", "caf\xe9": "string"} and found.rejected.count() == 0
    assert sorted(r["n"] for r in found.rows.collect()) == [1.0, 2.0, 3.5]
    (tmp_path / "c.csv").write_text("n,m\n")
    empty = scan.scan_csv(spark, str(tmp_path / "c.csv"))
    assert empty.types == {"n": "string", "m": "string"} and empty.rows.count() == 0


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark):
    layout.save_prices(daily(spark, SF), "laid_out", buckets=4)
    yield "laid_out"
    spark.sql("DROP TABLE laid_out")


def test_windows_and_joins_move_no_rows(spark, table):
    df = layout.prices(spark, table)
    assert sorted(map(str, df.collect())) == sorted(map(str, daily(spark, SF).select(*df.columns).collect()))
    w = Window.partitionBy("series_key").orderBy("timestamp")
    assert "Exchange" not in plan_of(df.withColumn("before", F.lag("price").over(w)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan_of(df.join(df.groupBy("series_key").agg(F.avg("price").alias("m")), "series_key"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_months_are_pruned_and_replaced_alone(spark, table):
    some = layout.prices(spark, table, "1997-03-10", "1997-05-02")
    text = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "month" in text.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    whole = {(r["series_key"], r["timestamp"]): r["price"] for r in layout.prices(spark, table).collect()}
    march = some.where(F.trunc("timestamp", "month") == "1997-04-01").withColumn("price", F.lit(1.0))
    n = march.count()
    layout.replace_months(march, table)
    after = {(r["series_key"], r["timestamp"]): r["price"] for r in layout.prices(spark, table).collect()}
    assert n > 0 and set(after) == set(whole) and sum(after[k] != whole[k] for k in whole) == n
    assert all(k[1].strftime("%Y-%m") == "1997-04" for k in whole if after[k] != whole[k])


def test_steps_are_counted_by_the_job_that_cleans(spark):
    p = Params(min_price=1_000.0, max_price=450_000.0, outlier_z=1.6, spike_pct=50.0)
    raw = raw_orders(spark, SF).withColumn("price", F.when(F.col("seq") % 5 > 0, F.col("price"))).repartition(3)
    done, seen = clean.clean_observed(raw, p)
    n = len(done.collect())
    counts = clean.step_counts(seen)
    assert counts[0]["rows"] == raw.count() and counts[-1]["rows"] == n == clean.clean(raw, p).count()
    assert sum(c["removed"] for c in counts) == counts[0]["rows"] - n and counts[0]["missing"] > 0 == counts[-1]["missing"]
    steps = {r["step"]: r["rows"] for r in clean.cleaning_steps(raw, p).groupBy("step").agg(F.sum("rows").alias("rows")).collect()}
    assert steps["kept"] == n and sum(v for k, v in steps.items() if k != "filled") == raw.count()
    assert [steps["repeated time"], steps["no time"] + steps["no price"], steps["impossible"], steps["outlier"]] == [c["removed"] for c in counts[1:]]


def test_correlations_of_many_columns(spark, monkeypatch):
    monkeypatch.setattr(correlate, "HELD", 2)
    rng = np.random.default_rng(1)
    rows = []
    for k in range(400):
        v = rng.normal(0, 1, 6) + np.array([0, 1e6, -50, 0, 0, 0])
        v[3] = v[0] + 0.1 * v[3]
        rows.append((None if k % 40 == 0 else f"s{k % 5}", *[None if rng.random() < 0.2 else float(x) for x in v], 3.0))
    df = spark.createDataFrame(rows, "series_key string, " + ", ".join(f"c{i} double" for i in range(7))).where("series_key is not null").repartition(4)
    names = [f"c{i}" for i in range(7)]
    got = {(r["series_key"], r["x"], r["y"]): (r["n"], r["correlation"]) for r in correlate.correlation_table(df, names).collect()}
    assert len(got) == 5 * 21
    frame = df.toPandas()
    for (key, x, y), (n, r) in got.items():
        both = frame[frame.series_key == key][[x, y]].dropna()
        assert n == len(both)
        if "c6" in (x, y):
            assert r is None
        else:
            assert r == pytest.approx(both[x].corr(both[y]), abs=1e-7)
    assert correlate.correlation_table(features.add_returns(daily(spark, SF).limit(0)), ["price", "returns"]).collect() == []
