"""Dense row identity 0..n-1 (the order contract of fold files)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigDataError
from ..session import materialize

ROW_ID = "_row_id"
BROADCAST_UNITS = 2_000_000  # 16 bytes each
_IN_PARTITION = (1 << 33) - 1  # low bits of monotonically_increasing_id


def rank_rows(
    df: DataFrame,
    keys: list[str],
    name: str = ROW_ID,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the 0-based rank of each row in key order; ``keep`` limits the other columns.

    Spark's range partitioning splits by all keys, so a leading value held by a third
    of the rows is still spread. The sorted rows are written once with their partition
    and position; partition sizes then turn these into ranks. There is no
    single-partition window, and ranks do not depend on how the file is read back.
    """
    ordered = df.orderBy(*keys).select(*(keep or df.columns))
    stored = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = stored.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    offsets, start = [], 0
    for row in counts:  # one row per partition
        offsets.append((row["_part"], start))
        start += row["count"]
    table = df.sparkSession.createDataFrame(offsets, "_part long, _start long")
    position = F.col("_at").bitwiseAND(F.lit(_IN_PARTITION))
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_start") + position)
        .drop("_part", "_at", "_start")
    )


def ingest_row_ids(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Add the row's position in its files: by path, then position in the file.

    ``df`` must be a plain file scan. Parquet rows know their index in the file, so an
    offset per file is enough. Rows of other formats are first written once with their
    block and position, since a later scan may cut the files differently. Either way
    no row is shuffled.
    """
    path = F.col("_metadata.file_path").alias("_path")
    try:
        tagged = df.select(
            "*", path, F.lit(0).alias("_block"), F.col("_metadata.row_index").alias("_at")
        )
    except AnalysisException:  # the format has no row index
        block = F.col("_metadata.file_block_start").alias("_block")
        tagged = materialize(
            df.select("*", path, block, F.monotonically_increasing_id().alias("_at"))
        )
    key = F.xxhash64("_path", "_block")
    units = (
        tagged.groupBy("_path", "_block")
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
        .orderBy("_path", "_block")
        .select(key.alias("_unit"), "_first", "_rows")
        .collect()
    )
    if len({row["_unit"] for row in units}) < len(units):
        raise ConfigDataError("Two input files share a hash; give [input].row_key instead")
    starts, start = [], 0
    for row in units:  # three numbers per file or block
        starts.append((row["_unit"], start - row["_first"]))
        start += row["_rows"]
    table = df.sparkSession.createDataFrame(starts, "_unit long, _shift long")
    if len(starts) <= BROADCAST_UNITS:
        table = F.broadcast(table)
    return (
        tagged.withColumn("_unit", key)
        .join(table, "_unit")
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .drop("_path", "_block", "_at", "_unit", "_shift")
    )
