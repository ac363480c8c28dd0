"""What operators need of the session: the package on executors, and lineage cut in the shared folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="gramquarry-")) / "gramquarry.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("gramquarry") / p.relative_to(root))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it. Only a local session without the
    setting, as in tests, gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gramquarry-checkpoint-"))
        at = sc.getCheckpointDir()
    return at


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder. Spark's cleaner removes the files when they are unreachable."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
