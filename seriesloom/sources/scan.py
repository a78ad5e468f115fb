"""Text tables with types: agreed over all rows, with what does not fit set apart and counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types that a column may have, the narrowest first; text if none fits.
KINDS = ("bigint", "double", "timestamp")
#: Share of a column's values that have to be of a type for the column to get it; the others are faults of their rows.
SHARE = 0.9
DAMAGED = "_damaged_line"


@dataclass
class Scan:
    """rows: all columns typed. rejected: the rows as text, with the reasons. types: (column, type, values, failures)."""

    rows: DataFrame
    rejected: DataFrame
    types: dict[str, str]
    failures: dict[str, int]


def agreed_types(df: DataFrame, share: float = SHARE) -> DataFrame:
    """(column, kind, values, failures) of a table of text, from one aggregate: the narrowest type that enough values have."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    counts = []
    for c in df.columns:
        fits = [F.count(F.expr(f"try_cast(trim(`{c}`) AS {k})")).alias(k) for k in KINDS]
        counts.append(F.struct(F.lit(c).alias("column"), F.count(text(F.col(f"`{c}`"))).alias("values"), *fits))
    out = df.agg(F.array(*counts).alias("a")).select(F.inline("a"))
    need = F.col("values") * share
    kind = F.lit("string")
    for k in reversed(KINDS):
        kind = F.when((F.col("values") > 0) & (F.col(k) >= need), F.lit(k)).otherwise(kind)
    out = out.withColumn("kind", kind)
    held = F.coalesce(*[F.when(F.col("kind") == k, F.col(k)) for k in KINDS], F.col("values"))
    return out.select("column", "kind", "values", (F.col("values") - held).alias("failures"))


def apart(df: DataFrame, types: dict[str, str], damaged: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with their types, rows that hold a value that its column's type cannot, as text with an array of reasons).

    Every row is in one of the two. A missing or blank value fits all types.
    """
    reasons = [F.when((F.trim(f"`{c}`") != "") & F.expr(f"try_cast(trim(`{c}`) AS {k})").isNull(), F.lit(f"{c} is no {k}")) for c, k in types.items() if k != "string"]
    if damaged:
        # a reader that needs some columns only would not see that a line has too many or too few: so all are looked at
        whole = F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in types])) >= 0
        reasons.append(F.when(F.col(damaged).isNotNull() & whole, F.lit("the line has another number of values")))
    marked = df.withColumn("_reasons", F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>"))
    typed = [(F.expr(f"try_cast(trim(`{c}`) AS {k})") if k != "string" else F.col(f"`{c}`")).alias(c) for c, k in types.items()]
    return marked.where(F.size("_reasons") == 0).select(*typed), marked.where(F.size("_reasons") > 0).withColumnRenamed("_reasons", "reasons")


def scan_csv(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8", share: float = SHARE, separator: str = ",") -> Scan:
    """CSV files with one header, as typed rows and rejected ones. Types are agreed over all files before any value is lost:
    a column of numbers with a few words in it stays one of numbers, and those rows are set apart."""
    charset = "ISO-8859-1" if encoding.lower() in ("latin-1", "latin1") else encoding
    reader = spark.read.option("header", True).option("encoding", charset).option("sep", separator)
    names = reader.csv(paths).columns
    schema = ", ".join([*[f"`{c}` string" for c in names], f"{DAMAGED} string"])
    lines = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", DAMAGED).option("enforceSchema", True).csv(paths)
    found = {r["column"]: r for r in agreed_types(lines.where(F.col(DAMAGED).isNull()).select(*[F.col(f"`{c}`") for c in names]), share).collect()}
    types = {c: found[c]["kind"] for c in names}
    rows, rejected = apart(lines, types, DAMAGED)
    return Scan(rows, rejected, types, {c: found[c]["failures"] for c in names})
