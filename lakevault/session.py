"""Sessions: the settings that this library relies on, and its code on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Shuffle files go when the query that made them ends, not only when the driver's memory is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application: their Python workers need not have it installed.

    Shuffle files are cleaned up after each query from then on, unless the application's settings say otherwise.
    """
    if spark.sparkContext.getConf().get(CLEANUP, None) is None:
        spark.conf.set(CLEANUP, "true")
    if (app := spark.sparkContext.applicationId) not in _shipped:
        root = Path(__file__).resolve().parent
        if root.is_dir():  # else it runs from an archive that was sent already
            to = Path(tempfile.mkdtemp(prefix="lakevault-")) / "lakevault.zip"
            with zipfile.ZipFile(to, "w") as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, str(p.relative_to(root.parent)))
            spark.sparkContext.addPyFile(str(to))
        _shipped.add(app)
    return spark


def session(master: str | None = None, name: str = "lakevault", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | conf)
    return ship((builder.master(master) if master else builder).getOrCreate())


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; unset, one of our own in local mode alone."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/checkpoints/lakevault"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: lineage ends, and nothing before is computed again."""
    work_dir(df.sparkSession)
    return df.checkpoint()
