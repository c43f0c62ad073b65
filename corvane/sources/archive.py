"""Saved indexes as one zip file, and back; bytes move between file systems inside the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def archive(spark: SparkSession, folder: str, target: str) -> None:
    """All files under a folder in the zip file ``target``."""
    jvm, root, fs = _at(spark, folder)
    _, to, other = _at(spark, target)
    base = fs.makeQualified(root).toString().rstrip("/") + "/"
    out = jvm.java.util.zip.ZipOutputStream(other.create(to, True))
    try:
        files = fs.listFiles(root, True)
        while files.hasNext():
            path = files.next().getPath()
            out.putNextEntry(jvm.java.util.zip.ZipEntry(path.toString().removeprefix(base)))
            source = fs.open(path)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            source.close()
            out.closeEntry()
    finally:
        out.close()


def extract(spark: SparkSession, source: str, folder: str) -> None:
    """The files of a zip file under a folder; names that lead out of it are an error, and nothing of them is written."""
    jvm, path, fs = _at(spark, source)
    _, _, other = _at(spark, folder)
    stream = jvm.java.util.zip.ZipInputStream(fs.open(path))
    try:
        while (entry := stream.getNextEntry()) is not None:
            name = entry.getName()
            if name.startswith("/") or ":" in name or "\\" in name or ".." in name.split("/"):
                raise ValueError(f"{name} leads out of the archive")
            if entry.isDirectory():
                continue
            out = other.create(jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}"), True)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            out.close()
    finally:
        stream.close()
