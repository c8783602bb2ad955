"""Getting this package to the Python workers, whatever folder the driver was started in."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_done: list[SparkContext] = []


def ship(spark: SparkSession) -> None:
    """Once per context: workers of the same machine get the folder on their path, those of a cluster the compiled package as a file.

    Nothing is sent where the driver's PYTHONPATH has the folder already, as its executors then have it too.
    """
    sc = spark.sparkContext
    if any(c is sc for c in _done):
        return
    _done.append(sc)
    paths = [p for p in (sc.environment.get("PYTHONPATH"), os.environ.get("PYTHONPATH")) if p]
    if str(ROOT) in ":".join(paths).split(":"):
        return
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.environment["PYTHONPATH"] = ":".join([str(ROOT), *paths])
        return
    target = Path(tempfile.mkdtemp(prefix="larkspur-")) / "larkspur.zip"
    with zipfile.PyZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        z.writepy(str(ROOT / "larkspur"))
        for data in (ROOT / "larkspur").rglob("*.json"):
            z.write(data, data.relative_to(ROOT))
    sc.addPyFile(str(target))
