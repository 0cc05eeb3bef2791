"""Makes the package importable on the executors."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the Python workers, once for a context.

    Nothing is sent where PYTHONPATH (which the workers inherit) leads to it."""
    context = spark.sparkContext
    if getattr(context, "_declarium_shipped", False):
        return
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT.parent not in paths and _ROOT.is_dir():
        target = Path(tempfile.mkdtemp(prefix="declarium-")) / "declarium_src.zip"
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(_ROOT.rglob("*.py")):
                out.write(path, path.relative_to(_ROOT.parent))
        context.addPyFile(str(target))
    context._declarium_shipped = True


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder in ``spark.checkpoint.dir`` and cut its lineage.
    Where it is unset, a local master (as in tests) gets a temporary folder; on a
    cluster that is an error."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='declarium-')}")
    return df.checkpoint(eager=True)
