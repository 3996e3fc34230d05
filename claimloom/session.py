"""Session settings, and the engine's own code for Python workers."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def build(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session with the settings that the queries assume: UTC, adaptive execution, last value wins in maps."""
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that workers can import it wherever they start."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, str(source.relative_to(root.parent)))
    folder = Path(tempfile.mkdtemp(prefix="claimloom-code-"))
    target = folder / "claimloom-code.zip"
    target.write_bytes(raw.getvalue())
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one on a local master, as
    in tests; on any other master that is an error, as executors would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.split("[")[0] == "local":
        raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share; the master is {master}")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="claimloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/claimloom/{uuid.uuid4().hex}-{label}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(hadoop_path)
    return path


def discard(df) -> None:
    """Deletes a scratch table when nothing reads it any more. Tables of other places stay as they are."""
    for file in df.inputFiles()[:1]:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getParent().getName() == "claimloom":
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
