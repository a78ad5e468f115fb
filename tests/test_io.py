"""Files, tables, scripts, the pipeline and the stream."""

from __future__ import annotations

import pandas as pd
import pytest

from seriesloom.operators import catalogue
from seriesloom.params import Params
from seriesloom.plans import pipeline
from seriesloom.sources import io
from seriesloom.sources.series import as_series
from seriesloom.streaming.bars import daily_bars
from tests.test_edges import series
from tests.test_models import walk


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "prices.csv"
    frame = pd.DataFrame({"Date": pd.date_range("2024-01-01", periods=200, freq="D").strftime("%Y-%m-%d %H:%M:%S"), "Close": walk(200, 7)})
    frame.loc[5, "Close"] = None
    pd.concat([frame, frame.iloc[[10]]]).to_csv(path, index=False)
    return str(path)


def test_load_and_inspect(spark, csv):
    df = io.load_prices(spark, csv)
    assert df.columns == ["timestamp", "price"] and dict(df.dtypes)["price"] == "double"
    seen = io.inspect(df)
    assert seen["rows"] == 201 and seen["nulls"]["price"] == 1 and len(seen["head"]) == 3
    assert io.endpoint("file:///{ticker}.csv", "X") == "file:///X.csv"


def test_latin_1(spark, tmp_path):
    p = tmp_path / "latin.csv"
    p.write_bytes("timestamp,price,name\n2024-01-01 00:00:00,1.5,caf\xe9\n".encode("latin-1"))
    assert io.load_prices(spark, str(p), encoding="ISO-8859-1").first()["name"] == "café"


def test_tables(spark):
    df = series(spark, [1.0, 2.0])
    io.save_table(df, "prices_test")
    io.save_table(df, "prices_test", "append")
    assert io.table_info(spark, "prices_test")["rows"] == 4
    with pytest.raises(Exception, match="exist"):
        io.save_table(df, "prices_test", "fail")
    spark.sql("DROP TABLE prices_test")


def test_scripts_keep_literals_and_go_on_after_errors(spark):
    script = "-- first; comment\nSELECT 'a;b' AS x; /* all ; of this */ SELECT broken FROM nowhere;\nSELECT 2 AS y -- end"
    assert io.split_statements(script) == ["SELECT 'a;b' AS x", "SELECT broken FROM nowhere", "SELECT 2 AS y"]
    got = io.run_script(spark, script)
    assert [e is None for _, _, e in got] == [True, False, True]
    assert got[0][1].first()["x"] == "a;b"


def test_pipeline_from_file_to_reports(spark, csv, tmp_path):
    out = str(tmp_path / "out")
    result = pipeline.run(spark, csv, out, script="SELECT count(*) AS n FROM series", p=Params(min_price=1.0, max_price=1000.0))
    assert result.cleaned.count() == 200
    assert "FINAL REPORT" in result.report and "total_anomalies" in result.report
    assert spark.read.parquet(f"{out}/featured").count() == result.featured.count() == 200 - 49
    assert spark.read.option("header", True).csv(f"{out}/queries/script_1").first()["n"] == "151"
    assert spark.read.parquet(f"{out}/metadata").first()["num_features"] == 67
    assert "ANOMALY" in spark.read.text(f"{out}/anomaly_report").first()[0]
    result.cleaned.unpersist()
    result.featured.unpersist()


def test_streamed_bars_are_the_batch_bars(spark, tmp_path):
    path = str(tmp_path / "in")
    batch = series(spark, walk(100, 8), step=pd.Timedelta(hours=5).to_pytimedelta())
    batch.write.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet(path)
    q = daily_bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars").start()
    try:
        q.processAllAvailable()
        got = spark.table("bars").orderBy("trade_date").toPandas()
    finally:
        q.stop()
    want = catalogue.daily_summary(batch).drop("volatility").orderBy("trade_date").toPandas()[list(got.columns)]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_default_key_is_one_series(spark):
    assert as_series(spark.createDataFrame([("2024-01-01", 1.0)], "timestamp string, price double")).first()["series_key"] == "ALL"
