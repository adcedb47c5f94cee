"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "hashloom", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings used in tests and in bench.py."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("HASHLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    On a cluster the session names it. Only where it is unset (local tests) a temporary folder is made, once per session.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().conf().get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="hashloom-checkpoint-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that a lost executor costs no lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_scratch: list[tuple[object, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver's Python ends: frames read from it may be used until then."""
    path = f"{shared_dir(spark)}/hashloom/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(drop_scratch)
    _scratch.append((spark.sparkContext._gateway.jvm, path))
    return path


def drop_scratch() -> None:
    """Deletes all scratch paths of this process at once. Frames read from them can't be used any more."""
    while _scratch:
        jvm, path = _scratch.pop()
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
        except Exception:  # noqa: BLE001, S112: the JVM or the folder is gone already
            continue


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's modules to the executors, once per context, so that Python workers find them whatever their path is."""
    sc = spark.sparkContext
    if not getattr(sc, "_hashloom_shipped", False):
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="hashloom-")) / "hashloom.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(target))
        sc._hashloom_shipped = True
    return spark
