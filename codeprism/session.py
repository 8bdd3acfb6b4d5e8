"""Session helpers: table access, the checkpoint folder, and a default local session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codeprism")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that they need no installed copy."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_codeprism_shipped", False):
        return
    d = tempfile.mkdtemp(prefix="codeprism-")  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    with zipfile.ZipFile(file := f"{d}/codeprism.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(file)
    sc._codeprism_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable.

    The folder named in ``spark.checkpoint.dir`` wins. A folder of our own is made only where none is
    set and the master is local; on a cluster a missing setting is an error, because a machine-local
    folder would lose its data with the executor.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="codeprism-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: its partitions and rows no longer change."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
