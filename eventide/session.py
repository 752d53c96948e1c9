"""Session helpers: settings the library relies on, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_scope = threading.local()

# Settings that change results or plans.  Cluster size is left to the caller.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
}
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # a line may repeat a key: the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build(master: str | None = None, app: str = "eventide", **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**REQUIRED, **RECOMMENDED}.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each application.

    Functions given to ``mapInPandas`` and the like are pickled by reference, so workers must be able to import them.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="eventide-")) / f"eventide-{sc.applicationId}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))


def require_utc(spark: SparkSession) -> None:
    tz = spark.conf.get("spark.sql.session.timeZone")
    if tz not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {tz}")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    A machine-local folder is only made for a local master (tests); on a
    cluster the setting has to be there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"eventide-{spark.sparkContext.applicationId}")
    os.makedirs(folder, exist_ok=True)
    return folder


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside, by this thread, are removed at its end: for jobs whose results are written elsewhere."""
    outer = getattr(_scope, "paths", None)
    _scope.paths = paths = []
    try:
        yield
    finally:
        _scope.paths = outer
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for p in map(jvm.org.apache.hadoop.fs.Path, paths):
            p.getFileSystem(conf).delete(p, True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Runs the plan so far once, cuts its lineage, and gives the planner true
    sizes.  For small tables that several later steps read.
    """
    path = os.path.join(shared_dir(df.sparkSession), "stage", uuid.uuid4().hex)
    if getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
