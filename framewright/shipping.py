"""Give executors the package, for sessions that were started without it on the Python path."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add a zip of the package to the session's Python files, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="framewright-")) / "framewright.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(target, "w") as z:
        for p in [*root.rglob("*.py"), *root.parent.glob("corpus_pipeline.py")]:
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _sent.add(sc.applicationId)


def shipped(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f(spark, ...) with ship(spark) before it."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        ship(spark)
        return f(spark, *args)

    return run
