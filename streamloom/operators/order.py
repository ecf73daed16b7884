"""Running totals in order of arrival that no single task has to read: rows are cut into blocks of positions, blocks are
summed, the sums (2^20 positions each) are carried along, and each block goes on from what was carried into it."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 20


def running(rows: DataFrame, name: str, value: Column, how: str, keys: tuple[str, ...] = (), pos: str = "pos", ties: tuple[str, ...] = (), levels: int = 1, bits: int = BITS) -> DataFrame:
    """Add name: the sum, max or last of value over the rows before, of equal keys; null if there are none.

    Positions need not be unique (ties decide, then chance) nor dense; if they are far apart, more levels carry sums of sums.
    The rows are computed twice: settle() what is dear.
    """
    order = [pos, *ties]
    if levels == 0:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, _folded(value, how).over(before))
    own, block, carry = (f"_{x}{levels}" for x in ("own", "block", "carry"))  # a name per level: each one's rows are the blocks of the one above
    cut = rows.withColumn(own, value).withColumn(block, F.shiftright(F.col(pos), bits))
    total = F.max_by(own, F.when(F.col(own).isNotNull(), F.struct(*order))) if how == "last" else _folded(F.col(own), how)
    blocks = cut.groupBy(*keys, block).agg(total.alias("_total"))
    carried = running(blocks, carry, F.col("_total"), how, keys, block, (), levels - 1, bits)
    carried = carried.select(carry, *(F.col(k).alias(f"_of_{k}") for k in [*keys, block]))
    same = functools.reduce(Column.__and__, [F.col(block) == F.col(f"_of_{block}"), *(F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys)])
    met = cut.join(carried, same, "left")
    within = Window.partitionBy(block, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here, came = _folded(F.col(own), how).over(within), F.col(carry)
    if how == "sum":
        both = F.coalesce(came + here, came, here)
    elif how == "max":
        both = F.greatest(came, here)
    else:
        both = F.coalesce(here, came)
    return met.withColumn(name, both).select(*rows.columns, name)


def _folded(value: Column, how: str) -> Column:
    return {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True)}[how](value)


def numbered(rows: DataFrame, name: str, **options) -> DataFrame:
    """Add name: numbers from 1, in order, of rows of equal keys."""
    return running(rows, name, F.lit(1).cast("long"), "sum", **options).withColumn(name, F.coalesce(name, F.lit(0).cast("long")) + 1)


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder the cluster names and read it back; what follows does not compute it again."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="streamloom-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(table: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """table marked for broadcasting if it has no more rows than that; otherwise the planner decides, by the sizes it finds."""
    return F.broadcast(table) if table.limit(most_rows + 1).count() <= most_rows else table
