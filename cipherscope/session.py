"""Prepares a session: this package on every executor, Arrow batches bounded by bytes."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch that goes to Python, where the session says nothing else; rows of text may be long.
BATCH_BYTES = 16 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors' Python workers, once an application, and bounds Arrow batches of the session."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="spark-")) / "cipherscope.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*")):
                if f.suffix in {".py", ".tsv"}:
                    z.write(f, Path("cipherscope") / f.relative_to(root))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark
