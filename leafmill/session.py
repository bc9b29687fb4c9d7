"""Making the package known to the executors."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from leafmill.tables import handed_over

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors once for each application, so that none needs it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(handed_over(spark, "leafmill.zip", data.getvalue()))
    _shipped.add(sc.applicationId)
