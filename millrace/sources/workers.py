"""Python workers on executors need this package where their PYTHONPATH lacks it: it goes to them as a zip, once for an application."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if app in _SENT:
        return
    _SENT.add(app)
    if any(p and Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    target = Path(tempfile.mkdtemp()) / "millrace-code.zip"  # code for addPyFile, which Spark hands to executors
    with zipfile.ZipFile(target, "w") as z:
        for p in (root / "millrace").rglob("*.py"):
            z.write(p, p.relative_to(root))
    path = list(sys.path)
    spark.sparkContext.addPyFile(str(target))
    sys.path[:] = path  # the driver keeps its own copy
