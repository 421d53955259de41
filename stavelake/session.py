"""Sessions: the package on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each context; Python functions of it then load everywhere.

    Documents are long, so Arrow batches get ``ROWS`` rows unless the session says otherwise.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(ROWS))
    if not getattr(context, "_stavelake_shipped", False):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="stavelake-")) / "stavelake.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path("stavelake") / p.relative_to(root))
        context.addPyFile(str(target))
        context._stavelake_shipped = True
    return spark
