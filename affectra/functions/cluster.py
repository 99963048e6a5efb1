"""What Python tasks need on a cluster: this package itself."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a Spark context, where they haven't got it."""
    sc = spark.sparkContext
    if not getattr(sc, "_affectra_shipped", False):
        top = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="affectra-")) / "affectra_package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(path))
        sc._affectra_shipped = True
