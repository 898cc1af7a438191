"""Session plumbing: building a session, shipping the package to executors, and cutting lineage in shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
_local_dirs: dict[str, str] = {}
_swept: set[str] = set()


def build_session(cpus: int = 8, app: str = "weftfacts") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the launcher's own session is used."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="weftfacts-ship-")
    atexit.register(shutil.rmtree, folder, True)
    target = Path(folder, "weftfacts_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset a folder of our own.

    Without the setting, a plain local session gets a temporary folder (driver and executor are one process there);
    any other master gets a folder under the warehouse, which a cluster shares by definition.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_weftfacts"
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="weftfacts-")
        atexit.register(shutil.rmtree, _local_dirs[app], True)
    return _local_dirs[app]


def _app_dir(spark: SparkSession) -> str:
    """This application's own folder below shared_dir; the file system deletes it when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/weftfacts-{spark.sparkContext.applicationId}"
    if path not in _swept:
        _swept.add(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(p)
        files.deleteOnExit(p)
    return path


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{_app_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that no plan reads any more: the superseded rounds of a loop."""
    for df in tables:
        path = getattr(df, "_weft_path", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
