"""Registry of the named queries over the test tables, with the SQL that checks them."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import extras, memory, sqlsuite

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**memory.QUERIES, **extras.QUERIES, **sqlsuite.QUERIES}
ORACLE_SQL: dict[str, str] = {**memory.ORACLE_SQL, **extras.ORACLE_SQL, **sqlsuite.ORACLE_SQL}

_SHIPPED: set[str] = set()


def ship(spark: SparkSession, root: str) -> None:
    """Send the package to the Python workers once per application, unless their path has it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    started_with = spark._jvm.System.getenv("PYTHONPATH") or ""
    if root in started_with.split(os.pathsep):
        return
    # Spark serves the archive from here as long as the application runs
    d = tempfile.mkdtemp(prefix="tesserine-package-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    top = os.path.join(d, "src")
    shutil.copytree(os.path.join(root, "tesserine"), os.path.join(top, "tesserine"), ignore=shutil.ignore_patterns("__pycache__"))
    pipeline = os.path.join(root, "corpus_pipeline.py")
    if os.path.exists(pipeline):
        shutil.copy(pipeline, top)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(d, "tesserine_package"), "zip", top))
