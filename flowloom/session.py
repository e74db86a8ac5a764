"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Applications whose executors have the package already.
_SHIPPED: set[str] = set()


def local_session(cores: int = 8, partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flowloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package; once per application.

    Not needed where the package is installed on the cluster or submitted with the job.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="flowloom-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    # Spark's own helpers beside the driver (stateful streams, data sources) do not see added files.
    places = [str(root.parent), sc.environment.get("PYTHONPATH", "")]
    sc.environment["PYTHONPATH"] = ":".join(p for p in places if p)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is used only when none is set and the session is a single process.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="flowloom-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new name below the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage.

    The rows outlive a lost executor.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
