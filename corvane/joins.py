"""Join helpers that size a side before they broadcast it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corvane.session import BROADCAST_BYTES, BROADCAST_ROWS, materialise, measured

#: Rows of one key beyond which they are spread over several tasks, and the most keys that are spread; with more
#: of them the bound rises with the table, so that the list of hot keys stays small.
HOT_ROWS, HOT_KEYS = 100_000, 20_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table that `materialise` gave may be broadcast."""
    seen = measured(df)
    return seen is not None and seen.rows <= rows and seen.size <= size


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salt_on: list[str] | None = None, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join `big` with a lookup side.

    The lookup side is computed once, into a table in the shared folder, which counts its rows and
    bytes. Up to `rows` and `size` it is broadcast, so a hot key of `big` costs nothing. Beyond that both
    sides are shuffled: keys of which `big` has more than `hot_rows` rows are spread over as many pieces as
    that takes, by a hash of `salt_on` (any columns that vary within a key), and only their lookup rows are
    repeated, once a piece. `how` is inner, left, left_semi or left_anti.
    """
    if measured(small) is None:
        small = materialise(small)
    if is_small(small, rows, size):
        return big.join(F.broadcast(small), keys, how)
    hot = _hot_keys(big, keys, hot_rows) if salt_on else None
    if hot is None:
        return big.join(small, keys, how)
    named = hot.select(*[F.col(k).alias(f"_hot_{i}") for i, k in enumerate(keys)], "_pieces")
    at: Column = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_hot_{i}")) for i, k in enumerate(keys)))
    salt = F.when(F.col("_pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(*salt_on), F.col("_pieces"))).cast("int")
    salted = big.join(F.broadcast(named), at, "left").select(*[big[c] for c in big.columns], salt.alias("_salt"))
    spread = small.join(F.broadcast(named), at, "left").select(*[small[c] for c in small.columns], F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces") - 1, F.lit(0)).cast("int"))).alias("_salt"))
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def shuffled_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join two sides neither of which is broadcast, whatever the threshold: Spark judges a side by the size of its files, not by what `explode` makes of them, and the driver would have to hold it."""
    return left.join(right.hint("merge"), keys, how)


def _hot_keys(big: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """Keys with more than `hot_rows` rows and the pieces they are cut into; partial counts are shuffled, not rows."""
    seen = Observation()
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).observe(seen, F.coalesce(F.sum("_n"), F.lit(0)).alias("all"))
    hot = materialise(counts.where(F.col("_n") > hot_rows))
    if not measured(hot).rows:
        return None
    least = max(hot_rows, seen.get["all"] // HOT_KEYS)
    return hot.where(F.col("_n") > least).select(*keys, F.ceil(F.col("_n") / least).cast("int").alias("_pieces"))
