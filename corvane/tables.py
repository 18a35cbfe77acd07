"""Loading of tables and the spelling rules that hold for keys, digests and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def norm_key(col: Column | str) -> Column:
    """Keys count trimmed of blanks and in lower case."""
    col = F.col(col) if isinstance(col, str) else col
    return F.lower(F.btrim(col, F.lit(BLANKS)))


def norm_path(col: Column | str) -> Column:
    """A path counts with `/` for every backslash and without a leading `./`."""
    col = F.col(col) if isinstance(col, str) else col
    slashed = F.translate(col, "\\", "/")
    return F.when(slashed.startswith("./"), F.substring(slashed, 3, 2_147_483_647)).otherwise(slashed)


def norm_digest(col: Column | str) -> Column:
    """Digests count in lower case."""
    return F.lower(F.col(col) if isinstance(col, str) else col)


def compact_digest(col: Column | str) -> Column:
    """A digest as bytes: half the length of its hexadecimal spelling, whatever that spelling.

    Text that is no hexadecimal number keeps its own bytes.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.unhex(F.lower(col)), F.encode(F.lower(col), "UTF-8"))
