"""Sends this package to the executors, which need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_folders: list[tempfile.TemporaryDirectory] = []


def ship(spark: SparkSession) -> None:
    """Once an application; Spark serves the archive from the driver."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.TemporaryDirectory(prefix="intervale-")  # the driver's own; Spark serves the archive from it until the end
    target = Path(folder.name) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in package.rglob("*.py"):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
    _folders.append(folder)


def shipped(df: DataFrame) -> DataFrame:
    """df, with the package sent first: for plans whose Python functions refer to it."""
    ship(df.sparkSession)
    return df
