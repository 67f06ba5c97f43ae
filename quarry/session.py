"""Session settings the engine expects."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; partition counts are left to the cluster unless given in ``conf``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir; where Spark runs in one process also under the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the executors, once a context, so that Python workers can import it anywhere; the active session's by default."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or getattr(spark.sparkContext, "_quarry_shipped", False):
        return
    sc = spark.sparkContext
    sc._quarry_shipped = True
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry-package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
