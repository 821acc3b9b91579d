"""Session settings and the shared folder for cut lineage."""

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# Folders of local test sessions that name none, by application.
_local_roots: dict[str, str] = {}
# Folders written by the scopes that are open, innermost last.
_scopes: list[list[str]] = []


def build_session(app: str = "vitaloom", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
                "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    workers_see(session, str(Path(__file__).parent.parent))
    return session


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the folder the cluster names; a local one only where none is named."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        root = _local_roots.get(app) or tempfile.mkdtemp(prefix="vitaloom-")
        _local_roots[app] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so lost executors do not recompute it.

    The files stay until the surrounding :func:`scratch` ends; without one they stay for good.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    """A path and its file system, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, in whatever store it is."""
    at, store = _folder(spark, path)
    return store.getFileStatus(at).isDirectory()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what :func:`cut_lineage` wrote inside: ``with scratch(spark): plan(...).write.parquet(result)``.

    Results must be written before the scope ends, because they read these files.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    at, store = _folder(spark, path)
    store.delete(at, True)


def complete_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders of ``path`` whose write has ended."""
    at, store = _folder(spark, path)
    if not store.exists(at):
        return []
    names = [f.getPath().getName() for f in store.listStatus(at) if f.isDirectory()]
    return sorted(n for n in names if store.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0]))


def workers_see(spark: SparkSession, folder: str) -> None:
    """Let Python workers that reach ``folder`` import from it, whatever directory the driver was started in."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if folder not in known:
        environment["PYTHONPATH"] = os.pathsep.join([folder, *[k for k in known if k]])


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a cluster that has no install of it, through the shared folder."""
    home = Path(__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    at, store = _folder(spark, f"{shared_folder(spark, 'package')}/{home.name}.zip")
    out = store.create(at)
    out.write(bytearray(data.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(at.toString())
