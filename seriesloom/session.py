"""Makes this package importable in Python workers of any cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's source to all executors, once per application, through Spark's own file server."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="seriesloom-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(f.name)
    _SHIPPED.add(app)
