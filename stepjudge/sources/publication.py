"""Publishing a table under a version so that readers see all of it or nothing.

A writer fills a folder of its own, ``<path>/_attempts/<id>``, lists its files with their lengths in a
manifest beside them, and then publishes by renaming the manifest to ``<path>/_published/<version>.json``.
A rename onto an existing name is refused, so of several writers of a version one wins and the others
withdraw their attempts; a write that breaks off has no manifest and is never read. Readers take the files
that the manifest names, and fail if one is gone or has another length. All paths go through Spark's file
systems; on a store without atomic renames two writers must not race.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _marker(path: str, version: str) -> str:
    return f"{path.rstrip('/')}/_published/{version}.json"


def published(spark: SparkSession, path: str, version: str) -> bool:
    p, fs = _path(spark, _marker(path, version))
    return fs.exists(p)


def publish(df: DataFrame, path: str, version: str) -> bool:
    """Write ``df`` and publish it as ``version``; False if the version is there already, or another writer was first."""
    spark = df.sparkSession
    if published(spark, path, version):
        return False
    attempt = f"{path.rstrip('/')}/_attempts/{version}-{uuid.uuid4().hex}"
    folder, fs = _path(spark, attempt)
    try:
        df.write.parquet(f"{attempt}/data")
        files = [s for s in fs.listStatus(_path(spark, f"{attempt}/data")[0]) if not s.getPath().getName().startswith(("_", "."))]
        manifest = json.dumps({"version": version, "files": [[s.getPath().toString(), s.getLen()] for s in files]})
        staged, _ = _path(spark, f"{attempt}/manifest.json")
        out = fs.create(staged, False)
        out.write(bytearray(manifest.encode()))
        out.close()
        won = _rename(spark, staged, _marker(path, version))
    except BaseException:
        fs.delete(folder, True)
        raise
    if not won:
        fs.delete(folder, True)
    return won


def _rename(spark: SparkSession, source, target: str) -> bool:
    """Rename unless the target exists."""
    from py4j.protocol import Py4JJavaError

    jvm = spark.sparkContext._jvm
    p, fs = _path(spark, target)
    fs.mkdirs(p.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri() if source.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(source, p, options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def read_published(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The table published as ``version``."""
    if not published(spark, path, version):
        raise FileNotFoundError(f"no version {version!r} published in {path}")
    manifest = json.loads(spark.read.text(_marker(path, version), wholetext=True).first()[0])
    files = []
    for name, length in manifest["files"]:
        p, fs = _path(spark, name)
        if not fs.exists(p) or fs.getFileStatus(p).getLen() != length:
            raise OSError(f"{name} is not as it was published in version {version!r}")
        files.append(name)
    return spark.read.parquet(*files)
