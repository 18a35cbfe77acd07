"""Writing derived tables so that readers never see half of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


class HeadMoved(RuntimeError):
    """Another writer published first."""


def publish(tables: dict[str, DataFrame], root: str, snapshot_id: str, expected_head: str | None = None) -> str:
    """Write all tables of a snapshot under a new name, then move the head to it; returns the version.

    Readers follow the head, so a failure before the last step leaves the old version in place; what was written is removed.
    The head is the last of numbered files, each made only if it is not there yet: of two writers one gets the next number,
    the other raises HeadMoved and removes its version. With `expected_head` nothing is published if the head has moved on since.
    """
    spark = next(iter(tables.values())).sparkSession
    number, current = _last_head(spark, root)
    if expected_head is not None and current != expected_head:
        raise HeadMoved(f"the head is {current}")
    version = f"{snapshot_id}-{uuid.uuid4().hex[:12]}"
    try:
        for name, table in tables.items():
            table.write.parquet(f"{root}/versions/{version}/{name}")
        fs, fresh = _fs(spark, f"{root}/heads/{number + 1:012d}.new-{version}")
        out = fs.create(fresh, True)
        out.write(bytearray(version.encode()))
        out.close()
        # A rename without overwriting succeeds for one writer only.
        target = _fs(spark, f"{root}/heads/{number + 1:012d}")[1]
        if fs.exists(target) or not _rename(spark, fresh, target):
            fs.delete(fresh, False)
            raise HeadMoved(f"head {number + 1} was taken")
    except Exception:
        delete_version(spark, root, version)
        raise
    return version


def _rename(spark: SparkSession, source, target) -> bool:
    """Atomically, without overwriting; false where the target came to be in between."""
    jvm = spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, none)
    except Exception as problem:  # noqa: BLE001
        if "FileAlreadyExists" in str(problem):
            return False
        raise
    return True


def _last_head(spark: SparkSession, root: str) -> tuple[int, str | None]:
    fs, folder = _fs(spark, f"{root}/heads")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    numbers = sorted(int(n) for n in names if n.isdigit())
    if not numbers:
        return 0, None
    return numbers[-1], spark.read.text(f"{root}/heads/{numbers[-1]:012d}", wholetext=True).first()[0]


def head(spark: SparkSession, root: str) -> str | None:
    """The version readers see, or None."""
    return _last_head(spark, root)[1]


def delete_version(spark: SparkSession, root: str, version: str) -> bool:
    """Remove one version that is not the head, such as one whose making failed; whether it was there."""
    if head(spark, root) == version:
        raise ValueError("the head stays")
    fs, folder = _fs(spark, f"{root}/versions/{version}")
    return bool(fs.delete(folder, True))


def rollback(spark: SparkSession, root: str) -> str | None:
    """Move the head to the version before it and remove the one that was the head; the new head, or None if there is none before."""
    number, current = _last_head(spark, root)
    fs = _fs(spark, f"{root}/heads")[0]
    for back in range(number - 1, 0, -1):
        path = _fs(spark, f"{root}/heads/{back:012d}")[1]
        if fs.exists(path):
            before = spark.read.text(f"{root}/heads/{back:012d}", wholetext=True).first()[0]
            if fs.exists(_fs(spark, f"{root}/versions/{before}")[1]):
                fs.delete(_fs(spark, f"{root}/heads/{number:012d}")[1], False)
                delete_version(spark, root, current)
                return before
    return None


def rebuild(spark: SparkSession, root: str, name: str, make) -> str:
    """A new version in which one table is derived again from the others (`make` gets a reader of them by name) and all else is taken over."""
    version = head(spark, root)
    if version is None:
        raise FileNotFoundError(f"no version under {root}")
    fs, folder = _fs(spark, f"{root}/versions/{version}")
    others = [s.getPath().getName() for s in fs.listStatus(folder)]
    tables = {n: read_head(spark, root, n) for n in others if n != name}
    return publish(tables | {name: make(lambda n: tables[n])}, root, version.rsplit("-", 1)[0], version)


def read_head(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = head(spark, root)
    if version is None:
        raise FileNotFoundError(f"no version under {root}")
    return spark.read.parquet(f"{root}/versions/{version}/{name}")


def prune_versions(spark: SparkSession, root: str, keep: int = 8) -> list[str]:
    """Delete all but the latest `keep` versions; the head stays. Returns what was deleted."""
    fs, folder = _fs(spark, f"{root}/versions")
    if not fs.exists(folder):
        return []
    found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(folder)), reverse=True)
    gone = [name for _, name in found[keep:] if name != head(spark, root)]
    for name in gone:
        fs.delete(_fs(spark, f"{root}/versions/{name}")[1], True)
    return gone


def overwrite_partitions(table: DataFrame, path: str, keys: list[str]) -> None:
    """Replace only the partitions that `table` has rows for."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_bounded(events: DataFrame, path: str, order: str, keep: int = 10_000) -> None:
    """Append to a log in folders by day, and remove days that lie wholly behind its latest `keep` rows."""
    spark = events.sparkSession
    events.withColumn("_day", F.to_date(order)).write.mode("append").partitionBy("_day").parquet(path)
    fs = _fs(spark, path)[0]
    for day in _days(spark, path, keep)[1]:
        fs.delete(_fs(spark, f"{path}/_day={day}")[1], True)


def _days(spark: SparkSession, path: str, keep: int) -> tuple[list[str], list[str]]:
    """(days that hold the latest `keep` rows, older ones), the latest first; counts come from the files' footers."""
    fs, folder = _fs(spark, path)
    days = sorted((n.removeprefix("_day=") for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.startswith("_day=") and "HIVE_DEFAULT" not in n), reverse=True) if fs.exists(folder) else []
    held = 0
    for i, day in enumerate(days):
        if held >= keep:
            return days[:i], days[i:]
        held += spark.read.parquet(f"{path}/_day={day}").count()
    return days, []


def read_bounded(spark: SparkSession, path: str, order: str, keep: int = 10_000) -> DataFrame:
    """The latest `keep` rows, from the days that hold them."""
    days = _days(spark, path, keep)[0]
    rows = spark.read.option("basePath", path).parquet(path)
    recent = rows.where(F.col("_day").cast("string").isin(*days) | F.col("_day").isNull()) if days else rows
    return recent.drop("_day").orderBy(F.col(order).desc()).limit(keep)


def write_artifact(rows: DataFrame, path: str, order: list[str]) -> None:
    """Records as JSON lines in one order, their fields by name, so that equal records give equal lines."""
    rows.select(*sorted(rows.columns)).orderBy(*order).write.mode("overwrite").json(path)
