"""The eight stages from raw prices to reports, for any number of series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import catalogue, clean, features, quality, signals, summary
from ..params import DEFAULTS, Params
from ..sources import io
from ..sources.series import as_series

#: Columns a series has before features are added.
_RAW = {"series_key", "seq", "timestamp", "price", "price_change_pct", "potential_spike"}


@dataclass
class Result:
    raw: DataFrame
    anomalies: DataFrame
    cleaned: DataFrame
    cleaning: DataFrame
    featured: DataFrame
    queries: dict[str, DataFrame]
    figures: DataFrame
    report: str


def run_frame(raw: DataFrame, source: str = "table", p: Params = DEFAULTS) -> Result:
    """From a frame of series. Cleaned and featured frames are kept, as several actions share them; unpersist them after."""
    anomalies = quality.all_checks(raw, p)
    cleaned = clean.clean(raw, p).persist()
    cleaning = clean.cleaning_report(raw, cleaned)
    featured = features.all_features(cleaned, p).persist()
    columns = [c for c in featured.columns if c not in _RAW]
    figures = summary.key_figures(featured, p)
    report = summary.final_report(figures, anomalies, cleaning, columns, source)
    return Result(raw, anomalies, cleaned, cleaning, featured, catalogue.run_all(featured, p), figures, report)


def run(spark: SparkSession, path: str, out: str, key: str | None = None, seq: str | None = None, script: str | None = None, p: Params = DEFAULTS, table: str = "series") -> Result:
    """Loads a file, runs all stages, and writes tables, query results, summaries and reports under ``out``.

    script: SQL statements that see the featured frame as a view called ``table``.
    """
    result = run_frame(as_series(io.load_prices(spark, path), key, seq), path, p)
    columns = [c for c in result.featured.columns if c not in _RAW]
    result.featured.createOrReplaceTempView(table)
    results = dict(result.queries)
    for k, (_, df, _) in enumerate(io.run_script(spark, script or ""), start=1):
        if df is not None:
            results[f"script_{k}"] = df
    result.featured.write.mode("overwrite").parquet(f"{out}/featured")
    io.run_metadata(result.featured, path, len(columns)).write.mode("append").parquet(f"{out}/metadata")
    io.save_results(results, f"{out}/queries")
    tables = {
        "cleaned": result.cleaned, "anomalies": result.anomalies, "summary_statistics": summary.describe(result.featured, ["price", *columns]),
        "signal_distribution": signals.value_counts(result.featured, "signal"), "feature_summary": features.feature_summary(result.featured, columns),
    }
    io.save_results(tables, out)
    for name, text in (("anomaly_report", quality.report(result.anomalies)), ("final_report", result.report)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/{name}")
    return result
