"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on.  Timestamps in the data are zone-less, and the
# oracle compares in UTC, so the session zone is pinned.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages may be megabytes each; keep Arrow batches into the shredder small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "pagecorpus") -> SparkSession:
    """Return a session with the engine's defaults (local sessions for tests and bench)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("PAGECORPUS_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_session_conf(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``pagecorpus`` importable in every Python worker (``mapInPandas`` /
    ``applyInPandas`` functions are pickled by reference): zip the package once per Spark
    context and add it with ``addPyFile`` -- the same as ``--py-files`` on a cluster."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="pagecorpus-pyfiles-", dir="/tmp")
    zpath = os.path.join(out_dir, "pagecorpus.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in base:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


def apply_session_conf(spark: SparkSession) -> None:
    """Pin the runtime settings the operators depend on (safe on an existing session)."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # pages may be megabytes each: small Arrow batches into the shredder
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")


_LOCAL_CKPT: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and written intermediates.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared file system).
    Only when it is unset -- local tests -- a scratch folder is created once per Spark
    context (core configs cannot be changed on a running session, so it is remembered
    here and given to ``setCheckpointDir``)."""
    try:
        configured = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:
        configured = None
    sc = spark.sparkContext
    if not configured:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not (sc.master or "").startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _LOCAL_CKPT:
        _LOCAL_CKPT[app] = tempfile.mkdtemp(prefix="pagecorpus-ckpt-", dir="/tmp")
        sc.setCheckpointDir(_LOCAL_CKPT[app])
    return sc.getCheckpointDir() or _LOCAL_CKPT[app]


def materialize(df, kind: str = "table"):
    return materialize_at(df, kind)[0]


def materialize_at(df, kind: str = "table"):
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor re-reads the table instead of recomputing the plan) and
    keeps the plan small when a result feeds several later steps."""
    import os
    import uuid

    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", kind, uuid.uuid4().hex)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fs_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (local, HDFS or object store alike)."""
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def fs_list(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries directly under ``path`` ([] when it does not exist)."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p)]


def fs_identity(spark: SparkSession, path: str) -> str:
    """Size and newest modification time of the files under ``path`` (one folder level): a table
    that is overwritten has another identity."""
    p, fs = _fs(spark, path)
    top = fs.getFileStatus(p)
    parts = fs.listStatus(p) if top.isDirectory() else [top]
    return f"{path}|{sum(s.getLen() for s in parts)}|{max([s.getModificationTime() for s in parts], default=0)}|{len(parts)}"


def fs_delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that this package wrote."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def fs_read_text(spark: SparkSession, path: str) -> str:
    """A small text file, through the Hadoop file system."""
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def fs_write_once(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file so that it appears whole or not at all: under another name first,
    then by one rename.  An existing file is an error."""
    import uuid

    p, fs = _fs(spark, path)
    temp, _ = _fs(spark, os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}.tmp"))
    stream = fs.create(temp, False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    if fs.exists(p) or not fs.rename(temp, p):
        fs.delete(temp, False)
        raise RuntimeError(f"{path} is committed already")
