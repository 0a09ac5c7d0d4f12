"""Makes the package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors, once for each application, so that Python functions can import it there."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="iterix-")) / "iterix_source.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(top.rglob("*.py")):
                archive.write(path, path.relative_to(top.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark
