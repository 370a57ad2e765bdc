"""Session helpers shared by the entry points, the bench and the tests."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "pairloom", cpus: int | None = None, partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench rely on."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one takes its place only under a
    local master, where driver and executors are one process; a cluster without the setting is refused, as parts
    written to each machine's own disk would be lost without an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if re.match(r"local(\[[^-]*\])?$", master := spark.sparkContext.master):
        return f"file://{tempfile.gettempdir()}/pairloom"
    raise RuntimeError(f"spark.checkpoint.dir is not set and the master is {master}: name a folder that all machines share")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. It is deleted when the driver ends; `discard` does so earlier."""
    path = f"{shared_root(spark)}/pairloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    fs.deleteOnExit(at.getParent())
    return path


_SPOOLED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def spool(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: what follows sees one and the same result, however
    often it is evaluated and whichever executor is lost."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    spooled = df.sparkSession.read.schema(df.schema).parquet(path)
    _SPOOLED[spooled] = path
    return spooled


def discard(*spooled: DataFrame) -> None:
    """Delete spooled tables that nothing will read again."""
    for df in spooled:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_SPOOLED.pop(df))
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once an application, so that nothing has to be installed there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="pairloom-ship-")) / "pairloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
