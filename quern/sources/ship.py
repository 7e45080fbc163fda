"""Sends this package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip, once for each context.

    Not needed where workers inherit a PYTHONPATH that holds it, which local masters do.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    sc._quern_shipped = True
    inherited = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if sc.master.startswith("local") and os.path.realpath(ROOT) in inherited:
        return
    target = Path(tempfile.mkdtemp(prefix="quern-code-")) / "quern.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((ROOT / "quern").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
