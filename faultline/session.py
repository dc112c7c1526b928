"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on; all can be set on a running session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # what a Python worker holds at once must not follow the length of texts
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # checkpoint files go with the plans that read them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
STATIC = ("spark.cleaner.referenceTracking.cleanCheckpoints",)


def local_session(app: str = "faultline", cores: str = "*", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**RUNTIME, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else made."""
    for key, value in RUNTIME.items():
        if key not in STATIC:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per context: their Python imports the code of the operators by name."""
    context = spark.sparkContext
    if getattr(context, "_faultline_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="faultline-code-")), "faultline_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    context._faultline_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or else of the context's checkpoints; a temporary one in local mode only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    local = context.master.startswith("local")
    if folder and not local and spark.conf.get("spark.faultline.mountedCheckpointDir", "false") != "true":
        # a bare path is in the default file system, whichever setting names that
        if _path(spark, folder)[1].getScheme() == "file" and not _mounted(spark, folder):
            raise RuntimeError(f"spark.checkpoint.dir is a local folder that some executors do not see: {folder}")
    if folder:
        return folder.rstrip("/")
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # the setting cannot be changed on a running session
    context.setCheckpointDir(os.path.realpath(tempfile.mkdtemp(prefix="faultline-")))
    return context.getCheckpointDir()


def _mounted(spark: SparkSession, folder: str) -> bool:
    """Whether tasks see a file that the driver puts into a local folder; asked once per context and folder."""
    context = spark.sparkContext
    known = context.__dict__.setdefault("_faultline_mounted", {})
    if folder not in known:
        at, files = _path(spark, f"{folder.rstrip('/')}/faultline-seen-{uuid.uuid4().hex}")
        files.create(at).close()
        path, tasks = at.toUri().getPath(), 4 * context.defaultParallelism
        known[folder] = all(context.parallelize(range(tasks), tasks).map(lambda _: os.path.exists(path)).collect())
        files.delete(at, False)
    return known[folder]


def _path(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _path(spark, path)
    return files.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what is directly in a folder; none if there is no such folder."""
    at, files = _path(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    """Take away a folder this library made."""
    at, files = _path(spark, path)
    files.delete(at, True)


def stable(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder, so later reads see the same rows in the same partitions."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
