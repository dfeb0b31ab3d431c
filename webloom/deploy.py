"""Give Python workers this package, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application; they need no install and no shared folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="webloom-"), "webloom_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query``, whose first argument is the session, with the package sent first."""

    @wraps(query)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run
