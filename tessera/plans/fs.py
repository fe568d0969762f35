"""Thin access to the Hadoop FileSystem of the session (local, HDFS, object stores).

Only manifests, pointers and listings go through here; all table data is read
and written by Spark jobs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _jpath(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _jpath(spark, path)
    return bool(fs.exists(p))


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _jpath(spark, path)
    stream = fs.open(p)
    try:
        jvm = spark.sparkContext._jvm
        data = jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
    finally:
        stream.close()
    return bytes(data).decode("utf-8")


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """Write a small file whole or not at all: to a name of its own first, then renamed into place.

    With ``overwrite=False`` the rename refuses an existing target (``FileExistsError``).
    """
    import uuid

    from py4j.protocol import Py4JJavaError

    fs, p = _jpath(spark, path)
    jvm = spark.sparkContext._jvm
    fs.mkdirs(p.getParent())
    temp = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temp, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if overwrite else rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(temp), fs.makeQualified(p), how)
    except Py4JJavaError as e:
        fs.delete(temp, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            raise FileExistsError(path) from e
        raise


def delete(spark: SparkSession, path: str, recursive: bool = True) -> bool:
    fs, p = _jpath(spark, path)
    return bool(fs.delete(p, bool(recursive)))


def mkdirs(spark: SparkSession, path: str) -> None:
    fs, p = _jpath(spark, path)
    fs.mkdirs(p)


def list_dir(spark: SparkSession, path: str) -> list[tuple[str, bool, int, int]]:
    """Immediate children as (name, is_dir, mtime_ms, length); empty if absent."""
    fs, p = _jpath(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        out.append((st.getPath().getName(), bool(st.isDirectory()), int(st.getModificationTime()), int(st.getLen())))
    return out


def du(spark: SparkSession, path: str) -> int:
    fs, p = _jpath(spark, path)
    if not fs.exists(p):
        return 0
    return int(fs.getContentSummary(p).getLength())


def join(base: str, *parts: str) -> str:
    return "/".join([base.rstrip("/"), *[x.strip("/") for x in parts]])
