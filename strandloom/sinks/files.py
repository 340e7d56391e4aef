"""Files as Hadoop's file system sees them, so every step also works on shared storage."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, size) of a folder's files, by name, without hidden ones and success marks."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return []
    found = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(p) if s.isFile()]
    return sorted(x for x in found if not x[0].rpartition("/")[2].startswith(("_", ".")))


def children(spark: SparkSession, path: str) -> list[str]:
    """Files and folders of a folder, by name."""
    fs, p = _path(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []


def size(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file or folder; None if there is none."""
    fs, p = _path(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else None


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename, in place of what is there."""
    fs, a = _path(spark, source)
    _, b = _path(spark, target)
    if fs.exists(b):
        fs.delete(b, True)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"can't move {source} to {target}")


def concatenate(spark: SparkSession, sources: list[str], target: str) -> None:
    """Join files into one, each deleted once it is copied, so there are never two whole copies."""
    fs, t = _path(spark, target)
    fs.mkdirs(t.getParent())
    out = fs.create(t, True)
    try:
        for source in sources:
            _, p = _path(spark, source)
            stream = fs.open(p)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
            fs.delete(p, False)
    finally:
        out.close()
