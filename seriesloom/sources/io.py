"""Files, tables and SQL scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .series import parse_timestamps, standardize_columns


def load_prices(spark: SparkSession, path: str, schema: StructType | str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header, or Parquet by its suffix; columns standardised and timestamps parsed.

    Without a schema, columns are read as text and the price is cast, which needs no pass over the file.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True).option("encoding", encoding)
        df = (reader.schema(schema) if schema else reader).csv(path)
    df = parse_timestamps(standardize_columns(df))
    return df.withColumn("price", F.expr("try_cast(price AS DOUBLE)"))


def endpoint(template: str, ticker: str) -> str:
    return template.format(ticker=ticker)


def inspect(df: DataFrame) -> dict:
    """Row count, types, null counts, first and last three rows by time, and summary figures; {} if it cannot be read."""
    try:
        nulls = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first().asDict()
        order = F.col("timestamp") if "timestamp" in df.columns else F.lit(0)
        return {
            "rows": nulls.pop("rows"), "columns": dict(df.dtypes), "nulls": nulls,
            "head": df.orderBy(order).limit(3).collect(), "tail": df.orderBy(order.desc()).limit(3).collect(), "summary": df.summary().collect(),
        }
    except Exception as e:  # noqa: BLE001  an inspector reports and goes on
        return {"error": str(e)}


def save_table(df: DataFrame, name: str, if_exists: str = "replace") -> None:
    """Managed Parquet table; if_exists: replace, append or fail. Sorted by time within files, for their statistics."""
    mode = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}[if_exists]
    if "timestamp" in df.columns:
        df = df.sortWithinPartitions(*[c for c in ("series_key", "timestamp") if c in df.columns])
    df.write.mode(mode).format("parquet").saveAsTable(name)


def table_info(spark: SparkSession, name: str) -> dict:
    return {"rows": spark.table(name).count(), "columns": [(c.name, c.dataType) for c in spark.catalog.listColumns(name)]}


def split_statements(script: str) -> list[str]:
    """Statements between semicolons; comments go, and both are left alone inside quotes."""
    out, now, quote, k = [], [], "", 0
    while k < len(script):
        c, two = script[k], script[k : k + 2]
        if quote:
            quote = "" if c == quote else quote
            now.append(c)
        elif two == "--":
            k = script.find("\n", k)
            if k < 0:
                break
            now.append("\n")
        elif two == "/*":
            end = script.find("*/", k + 2)
            k = len(script) if end < 0 else end + 1
            now.append(" ")
        elif c == ";":
            out.append("".join(now).strip())
            now = []
        else:
            quote = c if c in "'\"`" else ""
            now.append(c)
        k += 1
    return [s for s in [*out, "".join(now).strip()] if s]


def run_script(spark: SparkSession, script: str) -> list[tuple[str, DataFrame | None, str | None]]:
    """(statement, result, error) of each statement; a failure does not stop the rest."""
    results = []
    for s in split_statements(script):
        try:
            results.append((s, spark.sql(s), None))
        except Exception as e:  # noqa: BLE001  reported with its statement
            results.append((s, None, str(e)))
    return results


def save_results(results: dict[str, DataFrame], folder: str) -> list[str]:
    """Writes each result that has rows as CSV; gives the names written."""
    saved = []
    for name, df in results.items():
        if not df.isEmpty():
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
            saved.append(name)
    return saved


def run_metadata(df: DataFrame, source: str, n_features: int) -> DataFrame:
    """One row about a run: when, from what, how many rows, over which dates."""
    return df.agg(
        F.current_timestamp().alias("pipeline_run_time"), F.lit(source).alias("input_file"), F.count(F.lit(1)).alias("total_rows"),
        F.min("timestamp").alias("date_range_start"), F.max("timestamp").alias("date_range_end"), F.lit(n_features).alias("num_features"),
    )
