"""Session defaults and the few helpers that need more than a logical plan."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Rows and bytes (as `measured` counts them) up to which a lookup side may be broadcast. Beyond either `joins.lookup_join` shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000


def get_session(app: str = "corvane", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for local use; on a cluster the submitter's own settings are kept."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (
        ("spark.sql.session.timeZone", "UTC"),
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.execution.arrow.pyspark.enabled", "true"),
        ("spark.ui.enabled", "false"),
        ("spark.ui.showConsoleProgress", "false"),
    ):
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Where that setting is absent a local folder serves a session whose executors are threads of this
    process (tests, a laptop). Any other master raises: parts written to the executors' own disks would be lost.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    if not is_local(context.master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {context.master} share")
    return "file://" + os.path.join(tempfile.gettempdir(), "corvane-shared")


def is_local(master: str) -> bool:
    """Whether executors are threads of the driver's process."""
    return master == "local" or master.startswith("local[")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable for Python workers where nothing else does: neither their PYTHONPATH nor working folder nor an archive that holds it."""
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    context = spark.sparkContext
    if not os.path.isdir(package) or getattr(context, "_corvane_shipped", False):
        return
    context._corvane_shipped = True
    seen = [os.path.abspath(p) for p in (os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))]
    if context.master.startswith("local") and root in seen:
        return
    folder = tempfile.mkdtemp(prefix="corvane-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(os.path.join(folder, "corvane"), "zip", root, os.path.basename(package)))


_folders: set[str] = set()
_open: list[list[str]] = []


def _remove(spark: SparkSession, folder: str) -> None:
    """A driver that is killed leaves its files to the owner of the folder."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001
        pass


@contextlib.contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that `materialise` writes within are removed at the end, so results must be written or collected before.

    Without it they go when the driver ends, as results read them lazily.
    """
    _open.append([])
    try:
        yield
    finally:
        for folder in _open.pop():
            _remove(spark, folder)


def _width(column: Column, kind: DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 16
    return F.lit(8)


@dataclass(frozen=True)
class Measured:
    """What was written: rows and bytes (an upper bound if tasks were repeated)."""

    rows: int
    size: int


def measured(df: DataFrame) -> Measured | None:
    """Rows and bytes of a table that `materialise` gave, else None."""
    return getattr(df, "_corvane_measured", None)


def materialise(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cut the lineage of `df`: write it to the shared folder as Parquet, in folders of `by` if given, and read it back.

    The files outlive any executor. Used where a result feeds several later scans, so that it is
    computed once; the session's temporary names keep runs apart. Rows and bytes are counted on the way
    (`measured`).
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/corvane-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    target = f"{folder}/{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(target)
    seen = Observation()
    width = F.lit(16)
    for f in df.schema.fields:
        width = width + _width(F.col(f"`{f.name}`"), f.dataType)
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("size")).write.partitionBy(*by or []).parquet(target)
    out = spark.read.schema(df.schema).parquet(target)
    out._corvane_measured = Measured(seen.get["rows"], seen.get["size"])
    return out


def materialise_as(table: DataFrame, view: DataFrame) -> DataFrame:
    """`view`, a projection of rows of `table`, with what was measured of `table`."""
    view._corvane_measured = measured(table)
    return view
