"""What a session needs before Python functions of this package run on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's code to the executors, once in each application, so that it need not be
    installed there."""
    context = spark.sparkContext
    if getattr(context, "_spindrift_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spindrift-")) / "spindrift.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    context._spindrift_shipped = True
