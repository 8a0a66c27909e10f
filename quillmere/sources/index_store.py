"""Versions of an index with checksums, a verified restore and a swap by one small file.

    path/versions/<version>/data       the rows, as parquet
    path/versions/<version>/manifest   (file, bytes, sha256, rows_in_all, fingerprint), a row for each data file
    path/CURRENT-<n>                   the name of the version in use; the greatest n counts

A version is complete when its manifest is there; nothing points to it before. Files are hashed in tasks, one at a time
(FILE_ROWS bounds their size); the fingerprint is a sum over row hashes, so it does not depend on how rows are dealt to files.
Pointers are only added: a reader sees the old version or the new one, never half of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import file_system

FILE_ROWS = 1_000_000


def _data(path: str, version: str) -> str:
    return f"{path.rstrip('/')}/versions/{version}/data"


def _manifest(path: str, version: str) -> str:
    return f"{path.rstrip('/')}/versions/{version}/manifest"


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def fingerprint(rows: DataFrame) -> tuple[int, str]:
    """(rows, sum of row hashes) of a table; columns by name, so their order does not matter."""
    r = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")).first()
    return r.n, r.h


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of the data files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _complete(spark: SparkSession, path: str, version: str) -> None:
    n, h = fingerprint(spark.read.parquet(_data(path, version)))
    _files(spark, _data(path, version)).select("*", F.lit(n).cast("long").alias("rows_in_all"), F.lit(h).alias("fingerprint")).coalesce(1).write.parquet(_manifest(path, version))


def publish(points: DataFrame, path: str, version: str, use: bool = True) -> None:
    """Writes points as a version; it must not be there yet. With use, it becomes the current one."""
    spark = points.sparkSession
    if _exists(spark, _manifest(path, version)):
        raise FileExistsError(f"version {version} is complete")
    # Rows of an attempt that did not end are replaced.
    points.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(_data(path, version))
    _complete(spark, path, version)
    if use:
        point_to(spark, path, version)


def altered(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(file, problem): data files that are missing, altered or not in the manifest; empty if the version is whole."""
    if not _exists(spark, _manifest(path, version)):
        raise FileNotFoundError(f"version {version} has no manifest in {path}")
    told, found = spark.read.parquet(_manifest(path, version)), _files(spark, _data(path, version)).withColumnsRenamed({"bytes": "b", "sha256": "s"})
    problem = F.when(F.col("s").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when((F.col("bytes") != F.col("b")) | (F.col("sha256") != F.col("s")), "altered")
    return told.join(found, "file", "full").select("file", problem.alias("problem")).where("problem is not null")


def _pointers(spark: SparkSession, path: str) -> list[str]:
    fs, where = file_system(spark, f"{path.rstrip('/')}/CURRENT-*")
    found = [s.getPath().toString() for s in (fs.globStatus(where) or [])]
    return sorted(found, key=lambda p: int(p.rsplit("-", 1)[1]))


def current(spark: SparkSession, path: str) -> str | None:
    """The version in use, None before the first."""
    pointers = _pointers(spark, path)
    return spark.read.text(pointers[-1]).first()[0] if pointers else None


def point_to(spark: SparkSession, path: str, version: str) -> None:
    """Makes a complete version the current one: a file is written aside and renamed, which is one step."""
    if not _exists(spark, _manifest(path, version)):
        raise FileNotFoundError(f"version {version} has no manifest in {path}")
    pointers = _pointers(spark, path)
    n = int(pointers[-1].rsplit("-", 1)[1]) + 1 if pointers else 1
    fs, aside = file_system(spark, f"{path.rstrip('/')}/_writing-{n}-{version}")
    _, target = file_system(spark, f"{path.rstrip('/')}/CURRENT-{n:08d}")
    out = fs.create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        raise RuntimeError(f"another writer pointed {path} to a version at the same time")


def load(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The rows of a version, by default the current one."""
    version = version or current(spark, path)
    if version is None:
        raise FileNotFoundError(f"no current version in {path}")
    return spark.read.parquet(_data(path, version))


def restore(spark: SparkSession, backup: str, path: str, version: str) -> None:
    """Copies a version from another place and makes it the current one. Files are verified before, and the rows that arrived by their number and
    fingerprint after; on any difference it raises and the current version stays."""
    broken = altered(spark, backup, version).limit(5).collect()
    if broken:
        raise ValueError(f"version {version} of {backup} is damaged: {[tuple(r) for r in broken]}")
    told = spark.read.parquet(_manifest(backup, version)).select("rows_in_all", "fingerprint").first()
    if not _exists(spark, _manifest(path, version)):
        load(spark, backup, version).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(_data(path, version))
        _complete(spark, path, version)
    if told is not None and fingerprint(load(spark, path, version)) != (told.rows_in_all, told.fingerprint):
        raise ValueError(f"version {version} in {path} does not hold the rows of {backup}")
    point_to(spark, path, version)
