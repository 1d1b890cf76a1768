"""Numbers of rows in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with `name`: each row's place, from 1, in the given order.

    A range-partitioned sort, written once in the folder of checkpoints so that its partitions stay the same; the rows of
    all partitions before (one number a partition) are added to the place within. No task sees more than its partition."""
    names = df.columns
    placed = df.orderBy(*order).checkpoint().select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    sizes = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, table = 0, []
    for part in sorted(sizes):
        table.append((part, before))
        before += sizes[part]
    starts = df.sparkSession.createDataFrame(table, "__part int, __before long")
    place = (F.col("__before") + F.col("__at") + 1).cast("int" if before < 1 << 31 else "long")
    return placed.join(F.broadcast(starts), "__part").select(*[F.col(f"`{c}`") for c in names], place.alias(name))
